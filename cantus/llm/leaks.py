"""Problem 7: documents that hold passages of evaluation items.

Q-gram lemma filtering. Texts are reduced to their letters and digits, so case,
punctuation, spacing and markup do not matter. A passage of ``words`` words with a
budget of ``changed`` changed words keeps a computable number of its character
q-grams, and all of them lie near one diagonal. Each document counts the q-grams it
shares with every item in diagonal bands that overlap by half, so that a passage whose
diagonals lie within half a band of each other is whole in one of them; only bands
that reach the bound of one of the item's passages are aligned, by banded local
alignment. Documents are filtered and candidates aligned many at a time, in arrays.

The items are a stated query set: they are indexed in blocks of bounded size, every
block runs against all documents, and its passages are written before the next block
is built. Nothing of the documents is shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.plans.storage import cut, spread

Q = 8
BAND = 128
SLACK = 24  # diagonals around those of a band's q-grams that the alignment may use
PAD = 40  # characters before the first and behind the last of a band's q-grams
BLOCK_CHARS = 2_000_000  # of item text in one block's index, about 16 bytes each
CHUNK_CHARS = 800_000  # of document text in one array
CELLS = 4_000_000  # of alignment tables held at once
FILTER_BITS = 22
NOTHING = 0xFFFFFFFF
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W_]+")
SILENT = ("'", "’", "­", "​")
PASSAGE = "item_id bigint, doc_id bigint, words int, matched int, unbroken int, begins int, ends int"


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without markup, entities, accents of compatibility forms and apostrophes."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    text = unicodedata.normalize("NFKC", text).casefold()
    for sign in SILENT:
        text = text.replace(sign, "")
    return WORD.findall(text)


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    n = len(codes) - Q + 1
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class ItemIndex:
    """Q-grams of the own wording of some items, by hash, and the bounds of its passages.

    ``bodies``: (item id, words in a row, least words of a passage).
    """

    def __init__(self, bodies: list[tuple[int, list[str], int]], changed: int):
        self.ids, self.codes, self.word_of, self.bound, self.windows, self.least = [], [], [], [], [], []
        hashes, owner, place, need = [], [], [], []
        for item_id, body, words in bodies:
            k = len(self.ids)
            self.ids.append(item_id)
            self.least.append(words)
            codes = _codes("".join(body))
            sizes = np.array([len(w) for w in body])
            self.codes.append(codes)
            self.word_of.append(np.repeat(np.arange(len(body)), sizes))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            # per passage of ``words`` words: its first and last q-gram, and how many of them survive if the longest words change
            longest = np.sort(np.lib.stride_tricks.sliding_window_view(sizes, words), axis=1)[:, -changed:]
            kept = np.maximum(1, ends[words:] - ends[:-words] - Q + 1 - (longest + Q - 1).sum(axis=1))
            low, high = ends[: len(kept)], np.maximum(ends[: len(kept)] + 1, ends[words:] - Q + 1)
            self.windows.append((low, high, kept))
            self.bound.append(int(kept.min()))
            # per place: the least bound of the passages it lies in
            least = np.full(len(codes), np.iinfo(np.int32).max, np.int32)
            for a, z, n in zip(low.tolist(), high.tolist(), kept.tolist()):
                np.minimum(least[a:z], n, out=least[a:z])
            need.append(least)
            h = _gram_hashes(codes)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, self.starts = np.unique(h[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(h))
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int32)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.bounds = np.array(self.bound, np.int64)
        self.reach = np.array([int((high - low).max()) for low, high, _ in self.windows], np.int64)
        self.need = np.concatenate(need) if need else np.zeros(0, np.int32)
        self.need_at = np.concatenate([[0], np.cumsum([len(c) for c in self.codes])]).astype(np.int64)

    def bands(self, codes: np.ndarray, doc_at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, lowest diagonal, highest, first place, last place in the item) of the bands with a passage that reaches its bound.

        ``codes`` holds documents end to end, each behind a sign that no text has; ``doc_at`` tells where each begins.
        """
        h = _gram_hashes(codes)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return []
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[slot] == h[at]
        at, slot = at[good], slot[good]
        if not len(at):
            return []
        n = self.stops[slot] - self.starts[slot]
        post = np.repeat(self.starts[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        item, place = self.owner[post].astype(np.int64), self.place[post].astype(np.int64)
        doc = np.searchsorted(doc_at, at, side="right") - 1
        # documents that share too few q-grams with an item wherever they lie
        _, back, count = np.unique(doc << 32 | item, return_inverse=True, return_counts=True)
        good = count[back] >= self.bounds[item]
        at, item, place, doc = at[good], item[good], place[good], doc[good]
        diagonal = at - place
        found = []
        for shift in (0, BAND // 2):
            band = (diagonal + shift + (1 << 31)) // BAND
            order = np.lexsort((place, band, item, doc))
            d, i, b, p, g = doc[order], item[order], band[order], place[order], diagonal[order]
            if not len(d):
                continue
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            group = np.cumsum(new) - 1
            once = new | np.concatenate([[True], p[1:] != p[:-1]])
            # places of a band within the length of a passage from each place on, against the least bound there
            key, who = (group[once] << 32) + p[once], i[once]
            ahead = np.searchsorted(key, key + self.reach[who]) - np.arange(len(key))
            dense = np.unique(group[once][ahead >= self.need[self.need_at[who] + p[once]]])
            edge = np.flatnonzero(new)
            stop = np.append(edge[1:], len(d))
            for a, z in zip(edge[dense].tolist(), stop[dense].tolist()):
                places = p[a:z]
                places = places[np.concatenate([[True], places[1:] != places[:-1]])]
                low, high, kept = self.windows[k := int(i[a])]
                if np.any(np.searchsorted(places, high) - np.searchsorted(places, low) >= kept):
                    found.append((int(d[a]), k, int(g[a:z].min()), int(g[a:z].max()), int(places[0]), int(places[-1])))
        # neighbouring bands of a document and an item are aligned together
        out: list[tuple[int, int, int, int, int, int]] = []
        for c in sorted(found):
            o = out[-1] if out else None
            if o and o[:2] == c[:2] and c[2] <= o[3] + 1 and max(o[3], c[3]) - o[2] <= 2 * BAND:
                out[-1] = (*o[:3], max(o[3], c[3]), min(o[4], c[4]), max(o[5], c[5]))
            else:
                out.append(c)
        return out

    def passages(self, codes: np.ndarray, doc_at: np.ndarray, found: list[tuple[int, int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(document, item, words, whole words, longest unbroken run, first and last character in the document) of each band's best passage."""
        ends = np.append(doc_at[1:] - 1, len(codes))
        size = lambda c: (min(len(self.codes[c[1]]), c[5] + Q + PAD) - max(0, c[4] - PAD), c[3] - c[2])
        found = sorted(found, key=size)
        while found:
            rows, width = size(found[-1])
            width = max(c[3] - c[2] for c in found[-256:]) + 2 * SLACK + 1
            some = found[-max(1, min(256, CELLS // ((rows + 1) * (width + 2)))) :]
            del found[-len(some) :]
            yield from self._aligned(codes, doc_at, ends, some, rows, max(c[3] - c[2] for c in some) + 2 * SLACK + 1)

    def _aligned(self, codes: np.ndarray, doc_at: np.ndarray, ends: np.ndarray, some: list, rows: int, width: int):
        n = len(some)
        first = np.array([max(0, c[4] - PAD) for c in some])
        low = np.array([c[2] - SLACK for c in some])
        a = np.full((n, rows), NOTHING - 1, np.uint32)
        for k, c in enumerate(some):
            part = self.codes[c[1]][first[k] : first[k] + rows]
            a[k, : len(part)] = part
        at = (first + low)[:, None] + np.arange(rows + width)
        doc = np.array([c[0] for c in some])
        inside = (at >= doc_at[doc][:, None]) & (at < ends[doc][:, None])
        b = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], np.uint32(NOTHING))
        kind = np.int16 if rows + 2 * width < 30_000 else np.int32
        score = np.zeros((rows + 1, n, width + 2), kind)
        steps = np.arange(width, dtype=kind)  # +2 an equal character, -2 a changed, -1 a skipped one: a long word that is missing does not end a passage
        best, best_r, best_c = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in range(rows):
            up = score[r]
            row = (b[:, r : r + width] == a[:, r : r + 1]).astype(kind)
            row *= 4
            row += up[:, 1 : width + 1]
            row -= 1
            np.maximum(row, up[:, 2 : width + 2], out=row)  # same diagonal; item char skipped
            row -= 1
            np.maximum(row, 0, out=row)
            row += steps
            np.maximum.accumulate(row, axis=1, out=row)  # document chars skipped
            row -= steps
            score[r + 1, :, 1 : width + 1] = row
            top = row.max(axis=1)
            better = top > best
            if better.any():
                best[better], best_r[better], best_c[better] = top[better], r + 1, row.argmax(axis=1)[better] + 1
        # all ways back at once
        every, r, j, held = np.arange(n), best_r, best_c, best
        hits, seats = np.zeros((n, rows + 1), bool), np.zeros((n, rows + 1), np.int64)
        while len(every):
            same = b[every, r + j - 2] == a[every, r - 1]
            before, above, beside = score[r - 1, every, j], score[r - 1, every, j + 1], score[r, every, j - 1]
            along = held == before + np.where(same, 2, -2)
            over = ~along & (j < width) & (held == above - 1)
            met = along & same
            hits[every[met], r[met] - 1], seats[every[met], r[met] - 1] = True, (r + j - 2)[met]
            held = np.where(along, before, np.where(over, above, beside))
            r, j = r - (along | over), np.where(along, j, np.where(over, j + 1, j - 1))
            on = (r > 0) & (held > 0)
            every, r, j, held = every[on], r[on], j[on], held[on]
        for k, c in enumerate(some):
            word_of = self.word_of[c[1]]
            hit, seat, skip = np.zeros(len(word_of), bool), np.zeros(len(word_of), np.int64), int(first[k])
            upto = min(rows, len(word_of) - skip)
            hit[skip : skip + upto], seat[skip : skip + upto] = hits[k, :upto], at[k, 0] + seats[k, :upto]
            # the item's words from first to last of the segment with the largest sum of +1 a whole match, -2 a changed word
            sizes = np.bincount(word_of)
            whole = np.bincount(word_of, hit) == sizes
            # beside a gap a letter may be aligned with its like in the gap: a word is whole if it stands as such by any neighbour
            mine, stops = self.codes[c[1]], np.cumsum(sizes)
            near = np.concatenate([[False], hit, [False]])
            near = near[stops - sizes] | near[stops - sizes + 1] | near[stops] | near[stops + 1]
            for w in np.flatnonzero(~whole & near).tolist():
                z, size = int(stops[w]), int(sizes[w])
                x = z - size
                froms = [int(seat[q]) + d for q, d in ((x - 1, 1), (x, 0), (z - 1, 1 - size), (z, -size)) if 0 <= q < len(hit) and hit[q]]
                whole[w] = any(f >= doc_at[c[0]] and np.array_equal(codes[f : f + size], mine[x:z]) for f in froms)
            total = np.concatenate([[0], np.cumsum(np.where(whole, 1, -2))])
            lowest = np.minimum.accumulate(total)
            end = int((total - lowest).argmax())
            begin = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1])
            gaps = np.flatnonzero(np.concatenate([[True], ~whole[begin:end], [True]]))
            places = seat[(word_of >= begin) & (word_of < end) & hit] - doc_at[c[0]]
            yield c[0], c[1], end - begin, int(whole[begin:end].sum()), int(np.diff(gaps).max(initial=1)) - 1, int(places.min(initial=len(codes))), int(places.max(initial=0)) + 1


def _chunks(pdf: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
        if text is None or len(text) < 2 * Q:
            continue
        plain = "".join(plain_words(text))
        ids.append(doc_id)
        texts.append(plain)
        held += len(plain)
        if held >= CHUNK_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _search(index: ItemIndex):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, texts in _chunks(pdf):
                sizes = np.array([len(t) for t in texts])
                doc_at = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]) + 1
                codes = np.full(int(sizes.sum()) + len(texts) + 1, NOTHING, np.uint32)
                for at, text in zip(doc_at.tolist(), texts):
                    codes[at : at + len(text)] = _codes(text)
                out = [(index.ids[k], ids[d], n, same, run, a, z) for d, k, n, same, run, a, z in index.passages(codes, doc_at, index.bands(codes, doc_at)) if n >= index.least[k]]
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in PASSAGE.split(", ")])

    return rows


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, t in zip(pdf["item_id"], pdf["text"]):
            parts = [s for s in (" ".join(plain_words(s)) for s in SENTENCE.split(t)) if s]
            for k, s in enumerate(parts):
                rest = "\n".join(parts[:k] + parts[k + 1 :])
                out.append((i, k, s, blake2b(rest.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
        yield pd.DataFrame(out, columns=["item_id", "k", "sentence", "rest"])


def _bodies(sentences: list, words: int) -> list[tuple[list[str], int]]:
    """The runs of own wording of an item, each with the least words of a passage.

    An item with no such run, of shared wording only, leaks only as a whole: nine words in ten.
    """
    runs: list[list[str]] = [[]]
    for x in sentences:
        if x.shared:
            runs.append([])
        else:
            runs[-1].extend(x.sentence.split())
    out = [(r, words) for r in runs if len(r) >= words]  # a passage of words in a row cannot span shared wording
    every = [w for x in sentences for w in x.sentence.split()]
    return out or ([(every, max(words, -(-9 * len(every) // 10)))] if len(every) >= words else [])


def leaks(documents: DataFrame, items: DataFrame, words: int = 14, changed: int = 2, shared_by: int = 3, shared_share: float = 0.01) -> DataFrame:
    """item_id, doc_id, words, matched: documents with at least ``words`` words in a row of an item.

    Up to about ``changed`` in every ``words`` may be changed, added or missing; the
    first and the last word must be whole. Equal and nearly equal items are each
    reported. Items are written alike, so where another item explains more words of the
    same part of a document, an item counts only if ``words`` of its words stand there
    unbroken, or half as many again in all. A sentence does not count and parts the item
    if it stands in different surroundings in at least ``shared_by`` items and
    ``shared_share`` of all different ones (instructions, closing questions; equal items
    are one); an item of nothing else leaks only as a whole. NULL, empty and short texts
    on either side match nothing; repeated items and documents give one row a pair of ids.
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    parts = items.mapInPandas(_sentences, "item_id bigint, k int, sentence string, rest binary")
    different = F.greatest(F.lit(float(shared_by)), F.lit(shared_share) * F.col("items"))
    total = items.agg(F.countDistinct("text").alias("items"))  # one row
    shared = parts.groupBy("sentence").agg(F.countDistinct("rest").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= different).select("sentence", "n")
    marked = parts.join(shared, "sentence", "left").groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("k", "sentence", F.col("n").isNotNull().alias("shared")))).alias("s"))
    docs = spread(documents.select("doc_id", "text").where("text is not null and doc_id is not null"))
    found: list[DataFrame] = []

    def search(block: list[tuple[int, list[str], int]]) -> None:
        # one block's index is on the driver at a time
        found.append(cut(docs.mapInPandas(_search(ItemIndex(block, changed)), PASSAGE)))

    block, held = [], 0
    for row in marked.orderBy("item_id").toLocalIterator():
        for body, least in _bodies(row.s, words):
            block.append((row.item_id, body, least))
            held += sum(map(len, body))
        if held >= BLOCK_CHARS:
            search(block)
            block, held = [], 0
    if block or not found:
        search(block)
    passages = found[0]
    for x in found[1:]:
        passages = passages.unionByName(x)
    sure = (F.col("unbroken") >= words) | (F.col("matched") * 2 >= 3 * words)
    # few are not sure; a better item at their place explains them
    other = passages.select("doc_id", F.col("item_id").alias("o_item"), F.col("matched").alias("o_matched"), F.col("begins").alias("o_begins"), F.col("ends").alias("o_ends"))
    overlap = F.least("ends", "o_ends") - F.greatest("begins", "o_begins")
    better = (F.col("o_item") != F.col("item_id")) & (F.col("o_matched") > F.col("matched")) & (overlap * 2 > F.col("ends") - F.col("begins"))
    unsure = passages.where(~sure).alias("p").join(other.alias("o"), (F.col("p.doc_id") == F.col("o.doc_id")) & better, "left_anti")
    return passages.where(sure).unionByName(unsure).groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.max("matched").alias("matched"))
