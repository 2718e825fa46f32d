"""Tokens, leaks and cuts on small texts, with the awkward cases."""

import random

import pytest
from pyspark.sql import functions as F

from cantus.llm import cuts, leaks, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, ids string, line string, score string"


def docs_of(spark, texts, source="notes"):
    return spark.createDataFrame([(i, t, None, source, None, "w", "i", "l", "s") for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " ", "\n\n\t ", "don't I'LL we've", "<|endoftext|> is text", "naïve café — 가나다라 별빛", "a  b   c\r\n  d", " 　x y z", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "１２３ ½ Ⅳ 🎧🎶✨ \U0001f469‍\U0001f680", "x" * 3000 + "가" * 300, "'s't'LL 'd", "\x00\x1c\x85ok", "tail  "]


def test_ids_equal_the_tokenizer_and_decode_to_the_text(spark):
    tokenizers = pytest.importorskip("tokenizers")
    if not tokens.session_has_tokenizers():
        pytest.skip("no vocabulary files")
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice(" aeiouxyzéß가'0,.\n") for _ in range(200)) for _ in range(40)]
    df = docs_of(spark, texts)
    encoded = tokens.encode(df, head=50)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokens.decode(encoded).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}


def test_long_words_cost_in_proportion_and_equal_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    if not tokens.session_has_tokenizers():
        pytest.skip("no vocabulary files")
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(3)
    letters = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [letters("abcdefghijklmnopqrstuvwxyz", 30_000), "q" + "a" * 20_000, " " + "-" * 3000 + "é", "=" * 2000, "가나다" * 500, letters("가나다라蘭亭序日本語", 1500), "x" + "abc" * 1000, "_" * 777 + "-" * 777]
    for head in (0, 50):
        got = {r.doc_id: list(r.ids) for r in tokens.encode(docs_of(spark, texts), head=head).collect()}
        assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts))


def test_ids_of_no_documents(spark):
    if not tokens.session_has_tokenizers():
        pytest.skip("no vocabulary files")
    assert tokens.encode(docs_of(spark, []).limit(0)).count() == 0


ITEMS = "item_id bigint, text string, lang string, doc_id string, words string"
ASK = "Listen to the excerpt twice and answer the question that follows without using any instrument at all. "
BODY = [
    "The copper heron sings under seven bridges while a slow ferry carries violets toward the northern market, and nobody in the harbour counts the bells before dawn arrives with rain.",
    "A glass metronome argues with the tired cellist about measure ninety, although their quiet landlord hums a different waltz behind the kitchen door every single evening in March.",
    "Twelve lanterns drift past the observatory where an old tuner repairs broken pedals, because winter ships never wait for the choir to finish its longest and saddest hymn.",
    "Somewhere below the orchard a patient drummer folds paper maps of every tempo change, until the conductor forgets which river carried the missing trumpet back to town.",
]
FILLER = "We moved the passing note by eight bars and the chorus became airy at once. "


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, ASK + b, "en", "c", "c") for i, b in enumerate(BODY)] + [(90, None, None, "", ""), (91, "", None, "", ""), (92, "too short", "en", "", "")], ITEMS)


def quote(k, a, b):
    return " ".join(BODY[k].split()[a:b])


def test_leaks_whole_partial_edited_and_dressed(spark, items):
    edited = quote(2, 0, 28).split()
    edited[5], edited[14] = "pianist", "yellow"
    del edited[20]
    texts = [
        None, "", FILLER * 30, FILLER + BODY[0] + FILLER, FILLER + quote(1, 4, 20) + ". " + FILLER,
        FILLER + " ".join(edited) + FILLER,
        "<p>" + quote(3, 2, 22).upper().replace(" ", " <i>x</i> ".replace("x", "") + " ") + "</p>",
        ASK + FILLER,  # shared wording only
        FILLER + quote(0, 3, 10) + FILLER,  # a short quote
        FILLER * 400 + quote(3, 0, 20),  # at the end of a very long text
        quote(0, 0, 18) + " " + FILLER + quote(1, 0, 18),  # two items
        BODY[2],
    ]
    got = {(r.item_id, r.doc_id) for r in leaks.leaks(docs_of(spark, texts), items).collect()}
    assert got == {(0, 3), (1, 4), (2, 5), (3, 6), (3, 9), (0, 10), (1, 10), (2, 11)}


def test_leaks_in_blocks_of_items(spark, items, monkeypatch):
    df = docs_of(spark, [BODY[k] for k in range(4)])
    whole = {tuple(r) for r in leaks.leaks(df, items).collect()}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    assert {tuple(r) for r in leaks.leaks(df, items).collect()} == whole and len(whole) == 4


def test_equal_and_nearly_equal_items_are_all_reported(spark):
    same = spark.createDataFrame([(i, BODY[0], "en", "c", "c") for i in (1, 2, 3)], ITEMS)
    docs = docs_of(spark, [FILLER + BODY[0], BODY[0] + " " + FILLER])
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, same).collect()} == {(i, d) for i in (1, 2, 3) for d in (0, 1)}
    a = " ".join((BODY[0] + " " + BODY[1]).replace(",", "").replace(".", "").split()[:30])
    b = " ".join([*a.split()[:27], "zebra", "xylophone", "yonder"])
    two = spark.createDataFrame([(1, a, "en", "c", "c"), (2, b, "en", "c", "c")], ITEMS)
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs_of(spark, [a, b]), two).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_an_item_of_shared_wording_leaks_only_as_a_whole(spark):
    end = "Which of the four stems carries the theme here and where does it begin?"
    rows = [(i, ASK + b, "en", "c", "c") for i, b in enumerate(BODY)] + [(9, ASK + end, "en", "c", "c")] + [(20 + i, b + " " + end, "en", "c", "c") for i, b in enumerate(BODY)]
    docs = docs_of(spark, [ASK + FILLER, ASK + end, FILLER + end])
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, spark.createDataFrame(rows, ITEMS)).collect()} == {(9, 1)}


def _brute_force(item, doc):
    """Words of the item in the best local word alignment: +1 an equal word, -2 a changed, added or missing one."""
    best, row = (0, 0), [(0, 0)] * (len(doc) + 1)  # (score, where the passage begins in the item)
    for i, w in enumerate(item):
        new = [(0, i + 1)]
        for j, v in enumerate(doc):
            here = max((row[j][0] + (1 if w == v else -2), row[j][1] if row[j][0] > 0 else i), (row[j + 1][0] - 2, row[j + 1][1]), (new[j][0] - 2, new[j][1]), (0, i + 1), key=lambda x: x[0])
            new.append(here)
            if w == v and here[0] > best[0]:
                best = (here[0], i + 1 - here[1])
        row = new
    return best[1]


def test_recall_of_the_filter_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bdfglmnprstvaeiou가나다라") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 13]))) for _ in range(700)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(14, 40)) for _ in range(30)]
    docs = []
    for _ in range(150):
        item = rng.choice(items)
        size = rng.randint(10, len(item)) if len(item) > 10 else len(item)
        at = rng.randint(0, len(item) - size)
        part = item[at : at + size]
        for k in range(4, size - 4, rng.randint(9, 14)):  # edits inside, about one word in nine at most
            part[k] = rng.choice([[], [rng.choice(vocabulary)], [part[k], rng.choice(vocabulary)]])
        docs.append(text(rng.randint(0, 12)) + [w for x in part for w in (x if isinstance(x, list) else [x])] + text(rng.randint(0, 12)))
    frame = spark.createDataFrame([(i, " ".join(t), "xx", "c", "c") for i, t in enumerate(items)], ITEMS)
    got = {(r.item_id, r.doc_id) for r in leaks.leaks(docs_of(spark, [" ".join(t) for t in docs]), frame).collect()}
    want = {(i, d) for i, t in enumerate(items) for d, x in enumerate(docs) if _brute_force(t, x) >= 14}
    assert len(want) > 60
    assert len(want & got) >= 0.99 * len(want)
    assert len(got - want) <= 0.03 * len(got)


def test_leaks_of_nothing(spark, items):
    df = docs_of(spark, BODY)
    assert leaks.leaks(df.limit(0), items).count() == 0
    assert leaks.leaks(df, items.limit(0)).count() == 0


def captions():
    """Texts of a source with a limit of 120 characters and closings of its own."""
    rng = random.Random(7)
    words = "river silver tempo chorus guitar paper window slow bright hidden melody follows under every second bar while old drums answer".split()
    texts, cut = [], set()
    for i in range(900):
        t = ""
        for _ in range(rng.randint(1, 6)):
            t += " ".join(rng.choice(words) for _ in range(rng.randint(4, 9))).capitalize() + ". "
        t = t.strip()
        if rng.random() < 0.15:
            t += "\nstudio desk, room " + str(rng.randint(1, 20))
        elif rng.random() < 0.1:
            t += " #live #demo #loop"[: rng.choice([6, 12, 18])].rstrip(" #")
        if len(t) > 120 and rng.random() < 0.9:
            short = t[:120]
            if short.rstrip()[-1] not in ".#" and "studio" not in short[-25:] and "#" not in short[-20:]:
                cut.add(i)
            t = short
        texts.append(t)
    return texts, cut


def test_cuts_find_the_limit_and_the_cut_texts(spark):
    texts, cut = captions()
    texts += [None, "", "   ", "...", "!!", FILLER * 300]
    rows, limits = cuts.judged(docs_of(spark, texts, "captions"))
    assert (120, "chars") in {(r.high, r.unit) for r in limits.collect()}
    got = {r.doc_id for r in rows.where("is_cut").collect()}
    ambiguous = {i for i, t in enumerate(texts) if t and len(t) == 120 and i not in cut}
    assert len((got ^ cut) - ambiguous) <= 0.02 * len(cut)
    report = {r.source: r for r in cuts.by_source(docs_of(spark, texts, "captions")).collect()}
    assert report["captions"].cut_texts == len(got)


def test_copies_of_a_text_are_no_evidence_for_its_ending(spark):
    texts, cut = captions()
    torn = sorted(cut)[:3]
    copied = {torn[0]: 3, torn[1]: 40, torn[2]: 450}  # the last is a third of all rows
    rows = [(i, t, None, "captions", None, "w", "i", "l", "s") for i, t in enumerate(texts)]
    alone = {r.doc_id: (r.score, r.is_cut) for r in cuts.judged(spark.createDataFrame(rows, DOCS))[0].collect()}
    more = [texts[i] for i, n in copied.items() for _ in range(n)]
    owner = [i for i, n in copied.items() for _ in range(n)]
    rows += [(len(texts) + k, t, None, "captions", None, "w", "i", "l", "s") for k, t in enumerate(more)]
    rows += [(None, texts[torn[0]], None, "captions", None, "w", "i", "l", "s")] * 5
    rows += [(5000, texts[torn[0]], None, None, None, "w", "i", "l", "s")]  # the source is judged apart, the text counts once
    both = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.score, r.is_cut) for r in cuts.judged(both)[0].collect()}
    assert all(alone[i][1] for i in torn) and 5000 in got
    assert {i: v for i, v in got.items() if i < 5000} == alone | {len(texts) + k: alone[i] for k, i in enumerate(owner)}
    assert {len(texts) + k for k in range(len(more))} <= {r.doc_id for r in cuts.found(both).collect()}


def test_cuts_in_transfer_and_complete_endings(spark):
    whole, _ = captions()
    whole = [t for t in whole if len(t) < 110]
    cases = ["Tempo stays near the bri", "The river answers and the", "Tempo follows the old drums. �", "<p>The river answers.</p>\n<p>The slow dru", "Bright melody follows the …", "Slow river. (second listen)", "Slow river. :)", "Slow river! 🎧"]
    n = len(whole)
    got = {r.doc_id - n for r in cuts.found(docs_of(spark, whole + cases)).collect() if r.doc_id >= n}
    assert got == {0, 1, 2, 3, 4}


def test_equal_endings_differ_by_their_length(spark):
    """Unheard-of sign-offs: at the field limit a cut is likelier than a whole text, elsewhere it is not; lengths and endings can each overturn the other."""
    texts, _ = captions()
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("bdfglmnrstv") + rng.choice("aeiou") for _ in range(4))
    texts += [t[: rng.randint(20, 70)].rsplit(". ", 1)[0] + ".\n" + f"{name()} {name()} {name()}" for t in texts[:60]]
    body = "River follows slow old drums under the bar. Guitar and paper answer the window. "
    pairs = []
    for _ in range(5):
        sign = f"{name()} {name()} {name()}"
        pairs += [(body + "Tempo. " * 9)[: 119 - len(sign)] + "\n" + sign, (body + "Tempo.")[: 93 - len(sign)] + "\n" + sign]
    full = [(body + "Silver tempo answers every bar follows the slow drums")[:119] + "."]  # a full sentence at the limit
    n = len(texts)
    got = {r.doc_id - n: r for r in cuts.judged(docs_of(spark, texts + pairs + full, "captions"))[0].where(f"doc_id >= {n}").collect()}
    assert all(len(pairs[k]) == 120 and got[k].is_cut for k in range(0, 10, 2))
    assert not any(got[k].is_cut for k in range(1, 10, 2))
    assert all(got[k].ending == got[k + 1].ending for k in range(0, 10, 2))
    assert not got[10].is_cut and got[10].posterior > 0.5


def test_calibration_tells_the_two_kinds_apart():
    odds, shares, at_limit, elsewhere, tells = cuts.calibrated([("on words", 90.0, 20), ("new", 10.0, 100), ("stop words said", 0.0, 80), ("sentence", 10.0, 800)])
    assert tells == "on words" and odds["on words"] > 4 > odds["new"] > odds["stop words said"] > odds["sentence"]
    assert 0.85 < at_limit < 0.92 and 0.01 < elsewhere < 0.04
    assert cuts.calibrated([("new", 0.0, 0)])[0] == {"new": 0.0}


def test_cuts_of_nothing(spark):
    df = docs_of(spark, [None, ""])
    assert cuts.found(df).count() == 0
    assert cuts.by_source(df.limit(0)).count() == 0
    odd = df.unionByName(docs_of(spark, ["One text only"])).withColumn("source", F.lit(None).cast("string"))
    assert cuts.found(odd).count() <= 1
