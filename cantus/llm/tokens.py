"""Problem 6: the whole corpus as token ids of a public byte-level BPE.

The ranked merges are folded by Spark higher-order functions over the bytes of single
words. The rank map is a literal: a hash table of small maps, so a lookup costs the
same for any vocabulary; it stands once in the plan, bound to a lambda's variable. A
word is an array of pieces (their bytes in hexadecimal), each with the rank of the pair
it begins; a step joins the first pair of lowest rank and looks up only the two pairs
that are new.

A fold is quadratic in the word, so a long word is encoded through a window that moves
from token to token: the next window starts with a token of the last one, and the
join holds if the new window's encoding begins with that very token. In a byte-pair
encoding every two neighbouring tokens being their own encoding makes the whole one,
so the result is exact; where the tokens at a seam disagree, one is given back and the
window grows.

Words repeat, so they are encoded once where it pays: one pass counts the words of
all documents, and the ``head`` most frequent (a fixed number, however large the
corpus) become a second literal table; with fewer different words than that every word
is folded once. The rare rest is folded once a document that holds it, in place: to
join it would shuffle all texts. Documents are never exploded, joined or shuffled for
their ids.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
HEAD = 40_000
WINDOW, SEAM = 128, 48  # bytes of a long word folded at a time; bytes at a window's end whose tokens are not yet trusted
#: White space as Unicode has it (Java's \s is ASCII), and the tokenizer's own split pattern written with it.
SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}++| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def load_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hashed(entries: dict[str, object], value: str) -> tuple[Column, int]:
    """A literal array of small maps, the place of a key by its CRC-32; about one key a map."""
    size = 1 << max(1, (len(entries) - 1).bit_length())
    table: list[dict] = [{} for _ in range(size)]
    for k, v in entries.items():
        table[zlib.crc32(k.encode()) % size][k] = v
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{value}>>"), size


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed, or kept in the plan, once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _find(table: tuple[Column, int], key: Column) -> Column:
    literal, size = table
    slot = F.pmod(F.crc32(key.cast("binary")), F.lit(size)).cast("int")
    return F.try_element_at(F.get(literal, slot), key)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SPLIT})"), F.lit(1))


def _fold(hexed: Column, ranks: tuple[Column, int]) -> Column:
    """Pieces, in hexadecimal, of one word's bytes by ranked merges; each step costs two lookups."""
    piece = lambda h, then: F.struct(h.alias("h"), F.when(then.isNotNull(), _find(ranks, F.concat(h, then))).alias("r"))
    raw = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.substr(hexed, i, F.lit(2)))
    start = _let(raw, lambda p: F.transform(p, lambda h, i: piece(h, F.get(p, i + 1))))

    def step(p: Column, _: Column) -> Column:
        lowest = F.array_min(F.transform(p, lambda x: x.r))  # NULLs are left out
        at = F.when(lowest.isNull(), F.lit(0)).otherwise(F.array_position(F.transform(p, lambda x: x.r), lowest)).cast("int")

        def joined(k: Column) -> Column:  # k counts from 1
            h = F.concat(F.get(p, k - 1).h, F.get(p, k).h)
            left = F.when(k >= 2, F.array(piece(F.get(p, k - 2).h, h))).otherwise(F.slice(p, 1, 0))
            return F.concat(F.slice(p, 1, F.greatest(F.lit(0), k - 2)), left, F.array(piece(h, F.get(p, k + 1).h)), F.slice(p, k + 2, F.size(p)))

        return _let(at, lambda k: F.when(k == 0, p).otherwise(joined(k)))

    return F.aggregate(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), start, step, lambda p: F.transform(p, lambda x: x.h))


def _long(hexed: Column, ranks: tuple[Column, int], window: int, seam: int) -> Column:
    """Pieces of a long word through a moving window; NULL if that has not come to an end in twice the usual number of windows.

    State: pieces found, where the last of them begins (in hexadecimal digits; the next
    window starts there, and its encoding has to begin with that piece), and the bytes
    of the window. If it does not, the piece is given back and the window grows.
    """
    size = F.octet_length(hexed)
    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(0).alias("at"), F.lit(window).alias("bytes"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        inner = F.size(state.found) > 0

        def taken(p: Column) -> Column:
            new = F.when(inner, F.slice(p, 2, F.size(p))).otherwise(p)
            whole = state.at + 2 * state.bytes >= size
            agrees = (~inner | (F.get(p, F.lit(0)) == F.element_at(state.found, -1))) & (whole | (F.size(new) > 0))
            ends = F.aggregate(new, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(x))))
            first = F.when(inner, F.length(F.get(p, F.lit(0)))).otherwise(0)
            trusted = F.greatest(F.lit(1), F.size(F.filter(ends, lambda e: e + first <= 2 * (state.bytes - seam))))
            kept = F.when(whole, F.size(new)).otherwise(trusted)
            on = _let(kept, lambda k: F.struct(F.concat(state.found, F.slice(new, 1, k)).alias("found"), F.coalesce(state.at + first + F.get(ends, k - 1) - F.length(F.get(new, k - 1)), state.at).alias("at"), state.bytes.alias("bytes"), whole.alias("done")))
            left = F.slice(state.found, 1, F.size(state.found) - 1)
            back = F.struct(left.alias("found"), F.when(F.size(left) > 0, state.at - F.length(F.element_at(left, -1))).otherwise(0).alias("at"), (2 * state.bytes).alias("bytes"), F.lit(False).alias("done"))
            return F.when(agrees, on).otherwise(back)

        return F.when(state.done, state).otherwise(_let(_let(F.substr(hexed, state.at + 1, 2 * state.bytes), lambda w: _fold(w, ranks)), taken))

    windows = F.sequence(F.lit(1), F.ceil(size / (window - seam)).cast("int") + 64)
    return F.aggregate(windows, start, step, lambda s: F.when(s.done, s.found))


def fold(word: Column, ranks: tuple[Column, int], window: int = WINDOW, seam: int = SEAM) -> Column:
    """Token ids of one word."""
    def pieces(hexed: Column) -> Column:
        far = F.coalesce(_long(hexed, ranks, window, seam), _fold(hexed, ranks))
        return F.when(F.length(hexed) <= 2 * window, _fold(hexed, ranks)).otherwise(far)

    return F.transform(_let(F.hex(word.cast("binary")), pieces), lambda h: _find(ranks, h))


def encode(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, ids: every document's text as token ids, without special tokens.

    Strings that look like special tokens are ordinary text. A NULL and an empty text
    have the empty list; blank texts have the ids of their white space. Repeated
    documents are encoded each. Words of any length are encoded at a cost in proportion
    to their length.
    """
    table, size = _hashed({k.hex().upper(): v for k, v in load_ranks(folder, name).items()}, "int")
    docs = documents.select("doc_id", "text")
    counted = docs.where("text is not null").select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").count()
    common = counted.orderBy(F.desc("count"), "word").limit(head).select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")
    common = common.select("word", _let(table, lambda r: fold(F.col("word"), (r, size))).alias("ids"))
    # at most ``head`` rows, whatever the corpus holds
    known, known_size = _hashed({r.word: r.ids for r in common.toLocalIterator()}, "array<int>")

    def ids(tables: Column) -> Column:
        looked_up = F.transform(words_of(F.col("text")), lambda w: F.struct(w.alias("w"), _find((tables.known, known_size), w).alias("ids")))

        def filled(words: Column) -> Column:
            rare = F.array_distinct(F.transform(F.filter(words, lambda x: x.ids.isNull()), lambda x: x.w))
            return _let(F.map_from_arrays(rare, F.transform(rare, lambda w: fold(w, (tables.ranks, size)))), lambda m: F.transform(words, lambda x: F.coalesce(x.ids, F.try_element_at(m, x.w))))

        return _let(looked_up, filled)

    return docs.select("doc_id", F.flatten(_let(F.struct(table.alias("ranks"), known.alias("known")), ids)).alias("ids"))


def decode(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text: the concatenated binary pieces of the ids, read as UTF-8."""
    by_id = {v: k.hex().upper() for k, v in load_ranks(folder, name).items()}
    pieces = F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")
    binary = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""))
    return encoded.select("doc_id", F.decode(binary, "UTF-8").alias("text"))


def session_has_tokenizers(folder: str = TOKENIZERS) -> bool:
    return os.path.exists(os.path.join(folder, VOCABULARY))
