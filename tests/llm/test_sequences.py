"""Runs, patterns, top N and nearest times against plain Python, with the awkward cases."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cantus.llm import nearest, patterns, runs, segments, topn

T = datetime(2025, 1, 1)
SEGMENTS = "song string, segment_index int, start_sec double, end_sec double, duration double, pitch_class_set string, forte_class string, common_name string, root_pc int, loaded_at timestamp_ntz, mask string, chunk string, kind string"
CLASSES = [("3-11B", "0,4,7"), ("4-26", "0,3,7,10"), ("3-11A", "0,3,7"), ("4-20", "0,4,7,11"), ("4-27B", "0,4,7,10"), ("4-27A", "0,3,6,10"), ("3-12", "0,4,8"), ("4-22A", "0,2,4,7"), ("3-10", "0,3,6")]


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(c, "", "", len(z.split(",")), z) for c, z in CLASSES], "forte_class string, prime_form string, common_name string, cardinality int, root_zero_set string")


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SEGMENTS)


def made_up(seed=5, songs=7):
    rng, rows = random.Random(seed), []
    for s in range(songs):
        for i in range(400 if s == 0 else rng.randint(1, 40)):  # one song has most rows
            kind, root = rng.choice(CLASSES[:3]), rng.choice([0, 7])
            pcs = sorted((int(x) + root) % 12 for x in kind[1].split(","))
            rng.shuffle(pcs)
            style = rng.random()
            given = rng.choice([", ", ","]).join(map(str, pcs)) if style < 0.6 else None
            name = kind[0].replace("-", rng.choice(["-", "_", " - ", "–"])).lower() if style > 0.4 and style < 0.95 else None
            row = (f"s{s}", i, float(i // 2), None if rng.random() < 0.1 else i + 0.5, None, given, name, None, root + 12 * rng.randint(0, 3) if name else None, T + timedelta(seconds=rng.randint(0, 9)))
            rows.append(row)
            if rng.random() < 0.2:
                rows.append((*row[:5], None, row[6], None, row[8], row[9] + timedelta(days=1)))
    rng.shuffle(rows)
    return rows


def plain(rows):
    """song -> ordered list of (index, frozenset or None, class or None)."""
    zero = {c.replace("-", ""): [int(x) for x in z.split(",")] for c, z in CLASSES}
    named = {frozenset((x + r) % 12 for x in z): c for c, z in reversed([(c, [int(x) for x in z.split(",")]) for c, z in CLASSES]) for r in range(12)}
    by = {}
    for song, i, start, _, _, given, name, _, root, _ in rows:
        key = "".join(c for c in (name or "").upper() if c.isalnum())
        s = frozenset(int(x) % 12 for x in given.split(",")) if given else frozenset((x + root) % 12 for x in zero[key]) if key in zero else None
        c = next((k for k, _ in CLASSES if k.replace("-", "") == key), None) or named.get(s)
        old = by.get((song, i), (start, None, None))
        by[song, i] = (start, s or old[1], c or old[2])
    out = defaultdict(list)
    for (song, i), (start, s, c) in sorted(by.items(), key=lambda x: (x[0][0], x[1][0], x[0][1])):
        out[song].append((i, s, c))
    return out


def test_runs_match_a_plain_scan(spark, classes):
    rows = made_up()
    df = runs.chord_runs(segments.identified(rows_of(spark, rows), classes))
    want = set()
    total = 0
    for song, seq in plain(rows).items():
        total += len(seq)
        at = 0
        while at < len(seq):
            to = at
            while to + 1 < len(seq) and seq[at][1] is not None and seq[to + 1][1] == seq[at][1]:
                to += 1
            if to > at:
                want.add((song, seq[at][0], seq[to][0]))
            at = to + 1
    got = {tuple(r) for r in runs.found(df).collect()}
    assert got == want
    assert df.agg(F.sum("n_segments")).first()[0] == total


def test_runs_join_across_many_chunks(spark, classes, monkeypatch):
    """One chord through a whole song, cut into as many chunks as there are partitions, merged in two levels."""
    monkeypatch.setattr(runs, "FAN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        rows = [("a", i, float(i), i + 1.0, 1.0, "0,4,7", None, None, None, T) for i in range(500)] + [("b", 0, 0.0, 1.0, 1.0, None, None, None, None, T)]
        df = runs.chord_runs(segments.identified(rows_of(spark, rows), classes))
        assert {(r.song, r.first_index, r.last_index, r.n_segments, r.sounding_sec) for r in df.collect()} == {("a", 0, 499, 500, 500.0), ("b", 0, 0, 1, 1.0)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_runs_and_patterns_of_nothing(spark, classes):
    empty = segments.identified(rows_of(spark, []), classes)
    assert runs.chord_runs(empty).count() == 0
    assert patterns.frequent_patterns(empty).count() == 0
    nulls = rows_of(spark, [(None,) * 10, ("a", None, 1.0, None, None, None, None, None, None, None), ("a", 1, None, None, None, "x", "y", None, None, None), ("a", 2, 2.0, None, None, "", "9-9", None, 3, None)])
    df = segments.identified(nulls, classes)
    assert [(r.song, r.segment_index, r.mask, r.class_name) for r in df.collect()] == [("a", 2, None, None)]
    assert runs.found(runs.chord_runs(df)).count() == 0


@pytest.mark.parametrize("parts", ["2", "13"])
def test_patterns_match_enumeration(spark, classes, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = made_up(seed=9)
        want = defaultdict(set)
        for song, seq in plain(rows).items():
            items = [c for _, _, c in seq]

            def grow(path, at):
                if len(path) == 4:
                    want[">".join(path)].add(song)
                    return
                for q in range(at + 1, min(len(items), at + 4)):
                    if items[q]:
                        grow((*path, items[q]), q)

            for p, c in enumerate(items):
                if c:
                    grow((c,), p)
        got = {r.pattern: r.support for r in patterns.frequent_patterns(segments.identified(rows_of(spark, rows), classes), share=(2, 7)).collect()}
        assert got == {p: len(s) for p, s in want.items() if 7 * len(s) >= 2 * 7}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_diagrams_forget_without_losing(spark, classes, monkeypatch):
    """A tiny node budget makes the miner flush all the time; supports stay the same."""
    rows = made_up(seed=3, songs=5)
    df = segments.identified(rows_of(spark, rows), classes)
    want = {tuple(r) for r in patterns.frequent_patterns(df).collect()}
    monkeypatch.setattr(patterns, "MOST_NODES", 5)
    assert {tuple(r) for r in patterns.frequent_patterns(df).collect()} == want


def test_top_n_keeps_the_tie_rule(spark):
    rng = random.Random(2)
    rows = [(f"g{g}", i, rng.choice([0.0, 0.5, 0.5, 1.0, 0.25, rng.random()]), rng.randint(3, 5), float(rng.randint(0, 3))) for g in range(30) for i in range(2000 if g == 0 else rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "g string, i int, a double, b int, c double")
    got = topn.top_n(df, "g", [F.col("a"), F.col("b"), -F.col("c"), -F.col("i")], "i", 5)
    want = defaultdict(list)
    for g, i, a, b, c in sorted(rows, key=lambda r: (r[0], -r[2], -r[3], r[4], r[1])):
        if len(want[g]) < 5:
            want[g].append(i)
    have = defaultdict(set)
    for r in got.collect():
        have[r.group_key].add(r.item_key)
    assert have == {g: set(x) for g, x in want.items()}


CANDIDATES = "scope string, song string, segment_index int, segment_onset double, segment_offset double, n_notes bigint, n_non_chord_tone bigint, density double, chord_pitch_classes string, loaded_at timestamp_ntz, place string, code string"


def test_review_takes_the_latest_delivery_and_skips_no_candidates(spark):
    nan = float("nan")
    rows = [
        ("segment", "a", 1, 1.0, 2.0, 4, 4, 1.0, None, T),
        ("segment", "a", 1, 1.0, 2.0, 4, 2, 0.5, None, T + timedelta(days=1)),  # newer numbers
        ("segment", "a", 2, 2.0, 3.0, 4, 2, 0.5, None, T),
        ("segment", "a", 3, 3.0, 4.0, 5, 2, 0.5, None, T),
        ("segment", "a", 4, 4.0, 5.0, 0, 0, nan, None, T),
        ("segment", "a", 5, 5.0, 6.0, 3, 0, None, None, T),
        ("song", "a", None, None, None, 9, 9, 1.0, None, T),
        ("segment", None, 6, 6.0, 7.0, 9, 9, 1.0, None, T),
        (None, "b", 0, 0.0, 1.0, None, None, 0.1, None, None),
        (None,) * 10,
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CANDIDATES)
    got = {(r.song, r.place, r.segment_index) for r in topn.review_first(df).collect()}
    assert got == {("a", 1, 3), ("a", 2, 1), ("a", 3, 2), ("b", 1, 0)}
    assert topn.review_first(df.limit(0)).count() == 0


def test_top_n_with_salted_bounds(spark, monkeypatch):
    """The way for many groups: bounds joined by group and salt instead of broadcast."""
    monkeypatch.setattr(topn, "SMALL_GROUPS", 0)
    monkeypatch.setattr(topn, "HOT_PARTS", 20)  # every group is hot
    df = spark.createDataFrame([(f"g{i % 3}", i, float(i)) for i in range(300)], "g string, i int, a double")
    got = topn.top_n(df, "g", [F.col("a"), F.col("i")], "i", 4)
    assert sorted(r.item_key for r in got.collect()) == list(range(288, 300))


def test_top_n_with_identifiers_that_doubles_cannot_tell_apart(spark):
    big = 2**53
    df = spark.createDataFrame([("a", big + i, 1.0) for i in range(6)] + [("b", -big - i, None) for i in range(3)] + [("c", None, float("nan"))], "g string, i bigint, a double")
    got = {(r.group_key, r.item_key) for r in topn.top_n(df, "g", [F.col("a")], "i", 1).collect()}
    assert got == {("a", big + 5), ("b", -big), ("c", None)}
    names = ["", "a", "ab", "ab\x00", "abcdefgh", "abcdefghi", "한글 이름이 길다", "한글 이름이 길다!", "z", None]
    df = spark.createDataFrame([("g", n, 1.0) for n in names], "g string, i string, a double")
    for n in range(1, 10):
        want = sorted((x for x in names if x is not None), key=lambda x: x.encode(), reverse=True)[:n]
        assert {r.item_key for r in topn.top_n(df, "g", [F.col("a")], "i", n).collect()} == set(want)


def test_top_n_of_repeated_items_gives_n_rows_and_no_more(spark):
    df = spark.createDataFrame([("g", 1, 1.0)] * 5 + [("g", 2, 0.5), ("g", 2, 0.7), ("g", 3, 0.6), ("h", 4, 1.0)], "g string, i int, a double")
    got = sorted((r.group_key, r.item_key, r.code[0]) for r in topn.top_n(df, "g", [F.col("a")], "i", 2).collect())
    assert got == [("g", 1, 1.0), ("g", 2, 0.7), ("h", 4, 1.0)]


def test_nearest_matches_brute_force(spark):
    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.choice([None, float("nan"), rng.randint(0, 3_000_000) / 1e6]), i) for i in range(300)]
    right = [(rng.choice("ab"), rng.choice([None, *[rng.randint(0, 3_000_000) / 1e6] * 8]), i) for i in range(400)]
    left += left[:20] + [(None, 1.0, 900), ("a", 1.0, None)]
    right += right[:20] + [("a", 1.5, 998), ("a", 1.5, 997), ("a", 1.6, 996)]
    left.append(("a", 1.55, 950))  # equally far from 1.5 and 1.6, at the tolerance
    schema = "entity string, at double, id bigint"
    got = {(r.left_id, r.right_id) for r in nearest.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    want = {}
    for e, t, i in left:
        if e is None or i is None or t is None or t != t:
            continue
        near = [(abs(round(t * 1e6) - round(u * 1e6)), round(u * 1e6), j) for f, u, j in right if f == e and u is not None and j is not None]
        best = min((x for x in near if x[0] <= 50_000), default=None)
        if best:
            want[i] = best[2]
    assert got == set(want.items())


def test_nearest_of_nothing(spark):
    schema = "entity string, at double, id bigint"
    one = spark.createDataFrame([("a", 1.0, 1)], schema)
    assert nearest.nearest(one.limit(0), one).count() == 0
    assert nearest.nearest(one, one.limit(0)).count() == 0


def test_annotations_in_any_spelling_of_the_stem(spark):
    a = spark.createDataFrame([(1, "s", " OTHER ", 1.0), (2, "s", "bass", 1.0), (3, "s", None, 1.0), (4, "s", "Other", None)], "annotation_id bigint, song string, stem string, onset double")
    n = spark.createDataFrame([(10, "s", 1.01), (11, "s", 0.99), (12, "t", 1.0)], "note_id bigint, song string, onset double")
    assert [tuple(r)[:2] for r in nearest.annotations_to_notes(a, n).collect()] == [(1, 11)]
