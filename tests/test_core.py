"""Core operators against plain Python on hand-written rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.functions import chords
from cantus.operators import alignment, correction, matching
from cantus.operators.ordered import densest_windows, interval_as_of, with_context
from cantus.plans.alignment import leave_one_out, residuals
from cantus.plans.misc import resolve
from cantus.plans.sequences import quartile_exclusive
from cantus.plans.windows import time_of


def test_published_similarities():
    table = {c: m for (c, _, _), m in zip(chords.CHORD_CLASSES, chords.ZERO_MASKS)}
    j = lambda a, b: bin(table[a] & table[b]).count("1") / bin(table[a] | table[b]).count("1")
    assert j("3-11B", "4-20") == 0.75 and j("3-11A", "3-11B") == 0.5 and j("4-27A", "3-10") == 0.75
    freq = dict(zip(("3-11B", "4-26", "3-11A", "4-20", "4-27B", "4-27A", "3-12", "4-22A", "3-10"), (2108, 1650, 1499, 1221, 978, 458, 237, 110, 81)))
    mean = sum(freq[a] * freq[b] * j(a, b) for a in freq for b in freq) / 8342**2
    assert abs(mean - chords.CORPUS_MEAN_JACCARD) < 5e-4
    assert abs(chords.CHORD_SLOPE - 5.4611650485) < 1e-9 and abs(chords.NOTE_OFFSET - 0.8604118993) < 1e-9


def test_sets_and_classes_in_any_spelling(spark):
    rows = [("0, 4,7",), ("7,4,12",), ("",), (None,), ("abc",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(chords.parse_set(F.col("s"))).collect()]
    assert got == [145, 145, None, None, None]
    names = [(" 3 – 11b",), ("4_27A",), ("3‑12",), (None,), ("n/a",)]
    assert [r[0] for r in spark.createDataFrame(names, "s string").select(chords.normal_class(F.col("s"))).collect()] == ["3-11B", "4-27A", "3-12", None, None]


def test_context_crosses_blocks(spark):
    rng = random.Random(1)
    rows = [("a", t, i) for i, t in enumerate(rng.randint(0, 3000) for _ in range(200))] + [("b", 5, 0)]
    got = {(r.g, r.i): r for r in with_context(spark.createDataFrame(rows, "g string, t long, i int"), "g", "t", "i", F.col("i"), before=2, after=2, block_us=100, running=F.col("t")).collect()}
    for g in "ab":
        order = sorted((t, i) for h, t, i in rows if h == g)
        ids = [i for _, i in order]
        for k, (t, i) in enumerate(order):
            r = got[g, i]
            assert r.pos == k and r.running == sum(x for x, _ in order[: k + 1])
            assert list(r.prev) == ids[max(0, k - 2) : k][::-1] and list(r.next) == ids[k + 1 : k + 3]


def test_as_of_takes_the_last_start_even_if_it_has_ended(spark):
    segs = spark.createDataFrame([("a", 0, 100, 1), ("a", 50, 55, 2), ("a", 200, 300, 3)], "song string, start_us long, end_us long, mask int")
    notes = spark.createDataFrame([("a", t, k) for k, t in enumerate((0, 49, 52, 55, 90, 199, 200, 299, 300))] + [("z", 1, 99)], "song string, onset_us long, note_id int")
    for block in (7, 1000):
        got = {r.note_id: r.mask for r in interval_as_of(notes, segs, ["mask"], block_us=block).collect()}
        assert got == {0: 1, 1: 1, 2: 2, 3: None, 4: None, 5: None, 6: 3, 7: 3, 8: None, 99: None}


def test_densest_window_with_equal_onsets(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 0, 5, 10, 11, 30, 31, 32, 40)], "song string, onset_us long")
    assert [tuple(r) for r in densest_windows(df, 10).collect()] == [("a", 0, 10, 4)]


def reference_pass(notes):
    """The pass note by note: notes are (id, on, off, pitch, target or None) in order."""
    now, moved = {n[0]: n[3] for n in notes}, {}
    for i, on, off, pitch, target in notes:
        if target is None:
            continue
        hit = any(j != i and now[j] == target and a < off and on < b for j, a, b, _, _ in notes)
        moved[i] = not hit
        if not hit:
            now[i] = target
    return moved


def test_collision_pass_equals_the_walk_in_order(spark, monkeypatch):
    rng = random.Random(8)
    notes = [(i, t, t + rng.randint(1, 60), rng.randint(60, 66)) for i, t in enumerate(sorted(rng.randint(0, 800) for _ in range(120)))]
    targets = {i: p + rng.choice([-1, 1]) for i, _, _, p in notes if rng.random() < 0.6}
    df = spark.createDataFrame([("s", *n, "non_chord_tone", 0, 1, 4095) for n in notes], "song string, note_id int, onset_us long, offset_us long, pitch int, tag string, seg_start_us int, seg_end_us int, mask int")

    def stuck(tagged):
        placed = with_context(tagged, "song", "onset_us", "note_id", F.lit(1))
        t = spark.createDataFrame(list(targets.items()), "note_id int, target int")
        return placed.join(t, "note_id").withColumn("average", F.lit(0.0))

    monkeypatch.setattr(correction, "stuck", stuck)
    got = {r.note_id: r.moved for r in correction.corrected(df).collect()}
    want = reference_pass([(*n, targets.get(n[0])) for n in notes])
    assert got == want and len(set(got.values())) == 2


def test_nearest_tone(spark):
    rows = [(61, 145, None, 60), (61, 145, 70.0, 60), (62, 145, 80.0, 64), (62, 145, 10.0, 60), (62, 145, None, 60), (66, 273, None, 68)]
    df = spark.createDataFrame([(p, m, a) for p, m, a, _ in rows], "p int, m int, a double")
    got = [r[0] for r in df.select(correction.nearest_tone(F.col("p"), F.col("m"), F.col("a"))).collect()]
    assert got[:5] == [t for *_, t in rows[:5]] and got[5] in (64, 68)


def walk(kind, a, b, shift, local=True):
    """The textbook dynamic programme, cell by cell."""
    s = lambda x, y: int(alignment.scores(kind, x, np.array([y]), shift)[0])
    g = alignment.GAP_UNITS
    h = [[0 if local else g * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(*([0] if local else []), h[i - 1][j - 1] + s(a[i - 1], b[j - 1]), h[i - 1][j] + g, h[i][j - 1] + g)
            best = max(best, h[i][j])
    return best if local else h[-1][-1]


@pytest.mark.parametrize("kind", ["note", "chord"])
def test_alignment_scores(spark, kind, monkeypatch):
    rng = random.Random(3)
    draw = (lambda: rng.randint(-9, 9)) if kind == "note" else (lambda: rng.randint(0, 107))
    songs = {f"s{k}": [draw() for _ in range(rng.choice([0, 1, 5, 20, 30]))] for k in range(9)}
    monkeypatch.setattr(alignment, "BLOCK_SYMBOLS", 40)
    got = {(r.song_a, r.song_b): (r.score, r.best_transposition) for r in alignment.all_pairs(spark.createDataFrame(list(songs.items()), "song string, symbols array<int>"), kind).collect()}
    assert len(got) == 36
    for (a, b), (score, at) in got.items():
        each = [walk(kind, songs[a], songs[b], t) for t in range(12 if kind == "chord" else 1)]
        assert score == max(each) and at == each.index(max(each))
        best, pairs = alignment.local_alignment(kind, songs[a], songs[b], at)
        total = sum(alignment.GAP_UNITS if i is None or j is None else int(alignment.scores(kind, songs[a][i], np.array([songs[b][j]]), at)[0]) for i, j in pairs)
        assert best == total == score
        assert alignment.global_score(kind, songs[a], songs[b], 0) == walk(kind, songs[a], songs[b], 0, local=False)


@pytest.mark.parametrize("kind", ["note", "chord"])
def test_end_to_end_scores_of_all_pairs(spark, kind, monkeypatch):
    rng = random.Random(4)
    draw = (lambda: rng.randint(-40, 40)) if kind == "note" else (lambda: rng.randint(0, 107))
    songs = {f"{k % 3}{k}": [draw() for _ in range(rng.choice([0, 1, 5, 20, 30]))] for k in range(9)}
    monkeypatch.setattr(alignment, "BLOCK_SYMBOLS", 40)
    df = spark.createDataFrame(list(songs.items()), "song string, symbols array<int>")
    got = {(r.song_a, r.song_b): (r.score, r.best_transposition) for r in alignment.all_pairs(df, kind, "needleman_wunsch").collect()}
    assert len(got) == 36
    for (a, b), (score, at) in got.items():
        each = [walk(kind, songs[a], songs[b], t, local=False) for t in range(12 if kind == "chord" else 1)]
        assert score == max(each) and at == each.index(max(each))


@pytest.mark.parametrize("kind, name", [("chord", "nw_scores"), ("note", "nw_note_scores")])
def test_nw_scores_have_all_pairs(spark, kind, name):
    from cantus.plans import alignment as plans

    d = "/root/testdata/sf0.001"
    n = plans.symbol_sequences(spark, d, kind).count()
    rows = getattr(plans, name)(spark, d).collect()
    assert len({(r.song_a, r.song_b) for r in rows}) == len(rows) == n * (n - 1) // 2


def test_alignment_properties():
    rng = random.Random(5)
    notes, chord = [rng.randint(-12, 12) for _ in range(40)], [rng.randint(0, 107) for _ in range(25)]
    assert alignment.local_alignment("note", notes, notes)[0] == round(2.0 * 40 * alignment.UNIT)
    assert abs(alignment.local_alignment("chord", chord, chord)[0] / alignment.UNIT - 4.5932 * 25) < 1e-6
    turned = [c // 12 * 12 + (c % 12 + 5) % 12 for c in chord]
    assert alignment.local_alignment("chord", chord, turned, 7)[0] == alignment.local_alignment("chord", chord, chord)[0]


def test_leave_one_out(spark):
    rng = random.Random(6)
    pairs = [(f"s{i}", f"s{j}", rng.random()) for i in range(6) for j in range(i + 1, 6)]
    for r in leave_one_out(spark.createDataFrame(pairs, "song_a string, song_b string, x double"), "x").collect():
        z = []
        for s in (r.song_a, r.song_b):
            rest = [x for a, b, x in pairs if s in (a, b) and (a, b) != (r.song_a, r.song_b)]
            z.append(round((r.x - np.mean(rest)) / np.std(rest), 3))
        assert abs(r.z_a - z[0]) < 2e-3 and abs(r.z_b - z[1]) < 2e-3
    lone = leave_one_out(spark.createDataFrame([("a", "b", 1.0)], "song_a string, song_b string, x double"), "x").first()
    assert lone.z_a is None and lone.corpus_z is None


def test_residuals_of_a_plane_are_zero(spark):
    rng = random.Random(7)
    e = {f"s{k}": rng.random() * 3 for k in range(12)}
    rows = []
    for i in range(12):
        for j in range(i + 1, 12):
            a, b, (x, y) = rng.randint(2, 99), rng.randint(2, 99), (e[f"s{i}"], e[f"s{j}"])
            rows.append((f"s{i}", f"s{j}", a, b, 1 + 2 * math.log(min(a, b)) - math.log(max(a, b)) + 3 * min(x, y) + 0.5 * max(x, y)))
    got = residuals(spark.createDataFrame(rows, "song_a string, song_b string, len_a int, len_b int, raw_score double"), spark.createDataFrame(list(e.items()), "song string, entropy double"))
    assert max(abs(r.residual) for r in got.collect()) < 1e-3


def test_quartile_is_exclusive(spark):
    import statistics

    for values in ([1.0, 2.0, 3.0, 4.0], [5.0, 1.0, 1.0, 8.0, 2.0, 9.0, 4.0], [3.0, 1.0]):
        got = quartile_exclusive(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()[0]
        assert got == pytest.approx(statistics.quantiles(values, n=4)[0]) or len(values) == 2


def test_maximum_matching_needs_augmenting():
    assert len(matching.maximum_matching({0: [0, 1], 1: [0], 2: [1, 2]})) == 3
    rng = random.Random(9)
    for _ in range(50):
        edges = {i: [j for j in range(6) if rng.random() < 0.4] for i in range(6)}

        def best(i, used):
            return 0 if i == 6 else max([best(i + 1, used)] + [1 + best(i + 1, used | {j}) for j in edges[i] if j not in used])

        assert len(matching.maximum_matching(edges)) == best(0, frozenset())


def test_matched_counts_and_changes(spark):
    schema = "song string, id long, onset_us long, offset_us long, pitch int"
    ref = spark.createDataFrame([("a", 1, 0, 500_000, 60), ("a", 2, 60_000, 500_000, 60), ("a", 3, 900_000, 950_000, 61)], schema)
    est = spark.createDataFrame([("a", 1, 40_000, 500_000, 60), ("a", 2, 100_000, 900_000, 60), ("a", 3, 949_000, 2_000_000, 62)], schema)
    assert matching.matched_counts(ref, est).first().matched == 3
    assert matching.matched_counts(ref, est, pitched=True).first().matched == 2
    assert matching.matched_counts(ref, est, pitched=True, ratio=0.2).first().matched == 1
    assert tuple(matching.note_changes(ref, est).first())[1:] == (2, 1, 1)
    f = matching.f_measure(matching.matched_counts(ref, est)).first()
    assert (f.precision, f.recall, f.f_measure) == (1.0, 1.0, 1.0)


def test_times_and_names(spark):
    df = spark.createDataFrame([("1:30.5",), ("12.25",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(time_of(F.col("t"))).collect()] == [90.5, 12.25, None, None]
    songs = spark.createDataFrame([("Silver River",), ("Silver Road",), ("Kite",)], "song string")
    how = {w: tuple(resolve(songs, w).first())[1:] for w in ("Kite", "road", "silver", "Kte", "zzzz")}
    assert how == {"Kite": ("Kite", "exact"), "road": ("Silver Road", "contains"), "silver": (None, "none"), "Kte": ("Kite", "close"), "zzzz": (None, "none")} or Counter(how)["zzzz"] == 0


def test_lines_and_fields_of_every_source(spark):
    from cantus.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    sources = {r.source for r in spark.read.parquet(f"{d}/documents.parquet").where("text rlike '[a-z] [a-z]'").select("source").distinct().collect()}
    for name in ("manifest_lines", "log_fields"):
        assert {r.source for r in QUERIES[name](spark, d).select("source").distinct().collect()} >= sources and len(sources) > 1


def test_as_of_repeats_no_interval(spark):
    """One interval of 10^12 microseconds among many: nothing is repeated over the blocks it spans, and the last start still wins."""
    from cantus.operators.ordered import interval_as_of

    segs = [("a", i * 50_000_000, i * 50_000_000 + 30_000_000, i) for i in range(1, 200)] + [("a", 0, 10**12, 0), ("b", 0, 10**12, 7), ("c", 5, None, 1)]
    notes = [("a", i, t) for i, t in enumerate(range(0, 12_000_000_000, 35_000_001))] + [("b", 0, 10**12 - 1), ("b", 1, 10**12), ("c", 0, 6), ("d", 0, 1)]
    s = spark.createDataFrame(segs, "song string, start_us bigint, end_us bigint, mask int")
    n = spark.createDataFrame(notes, "song string, note_id int, onset_us bigint")
    got = {(r.song, r.note_id): r.mask for r in interval_as_of(n, s, ["mask"]).collect()}
    for song, k, t in notes:
        last = max(((a, b, m) for g, a, b, m in segs if g == song and a <= t and b is not None), default=None)
        assert got[song, k] == (last[2] if last and t < last[1] else None)


def test_reconciliation_finds_each_planted_problem(spark):
    from cantus.operators import correction as op

    merged = spark.createDataFrame([("a", i, i * 1000, 60, 0b000010010001) for i in range(6)], "song string, id int, onset_us bigint, pitch int, mask int")
    after = [60, 64, 64, 61, 60, 64]
    corrected = spark.createDataFrame([("a", i, i * 1000, p) for i, p in enumerate(after)], "song string, id int, onset_us bigint, pitch int")
    log = spark.createDataFrame([("a", 1000 + 90, 60, 64), ("a", 2000, 60, 67), ("a", 3000, 60, 61), ("a", 4000, 60, 64), ("b", 0, 60, 61)], "song string, onset_us bigint, original_pitch int, corrected_pitch int")
    got = {(r.note_id, r.problem) for r in op.reconcile(merged, corrected, log).collect()}
    assert got == {(2, "entry with another pitch"), (3, "corrected outside the chord"), (4, "entry without a change"), (5, "changed without an entry")}
    short = op.reconcile(merged, corrected.where("id < 5"), log.limit(0))
    assert {r.problem for r in short.where("place = 5").collect()} == {"no partner"}


def test_last_log_entry_wins_and_statuses(spark):
    from cantus.operators import correction as op

    log = spark.createDataFrame([("a", 5, 64, 60, 1), ("a", 5, 64, 62, 2), ("a", 5, 65, 61, 1)], "song string, onset_us bigint, corrected_pitch int, original_pitch int, place int")
    assert {(r.corrected_pitch, r.original_pitch) for r in op.last_entries(log).collect()} == {(64, 62), (65, 61)}
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "song string")
    assert {tuple(r) for r in op.song_status(names("a", "b", "c", "a"), names("a"), names("a", "b", "x")).collect()} == {("a", "ok"), ("b", "failed"), ("c", "not_processed")}


def test_kth_smallest_by_counting(spark, monkeypatch):
    import random

    from cantus.plans import sequences

    monkeypatch.setattr(sequences, "FEW", 5)
    monkeypatch.setattr(sequences, "PARTS", 4)
    rng = random.Random(4)
    values = [rng.choice([0.5, 0.5, rng.random(), -rng.random() * 100]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for k in (1, 50, 200):
        assert sequences.kth_smallest(df, "x", k) == sorted(values)[k - 1]
    assert sequences.kth_smallest(df.limit(0), "x", 1) is None


def test_a_bad_sequence_fails_only_its_pairs(spark):
    from cantus.operators import alignment as op

    df = spark.createDataFrame([("a", [0, 1, 2]), ("b", [-5, 3]), ("c", [0, 1, 2])], "song string, symbols array<int>")
    rows = {(r.song_a, r.song_b): r for r in op.all_pairs(df, "chord").collect()}
    assert rows["a", "c"].error is None and rows["a", "c"].score > 0
    assert rows["b", "c"].error and rows["b", "c"].score == -1


def test_long_local_alignment_needs_little_memory():
    import tracemalloc

    import numpy as np

    from cantus.operators.alignment import local_alignment

    rng = np.random.default_rng(2)
    a = rng.integers(-12, 13, 3000)
    tracemalloc.start()
    score, pairs = local_alignment("note", a, a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 3000 and all(i == j for i, j in pairs) and peak < 20_000_000


def test_end_to_end_traceback_scores_what_it_says():
    import numpy as np

    from cantus.operators import alignment as op

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(-4, 5, rng.integers(0, 12)), rng.integers(-4, 5, rng.integers(0, 12))
        score, pairs = op.global_alignment("note", a, b)
        assert score == op.global_score("note", a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert score == sum(op.GAP_UNITS if i is None or j is None else int(op.scores("note", int(a[i]), b[j : j + 1])[0]) for i, j in pairs)


def test_sample_sweep_names_missing_songs(spark):
    from cantus.operators import alignment as op

    df = spark.createDataFrame([("a", [0, 2, -2, 5, 0, 2]), ("b", [0, 2, -2, 5, 1]), ("c", [7, 7, 7])], "song string, symbols array<int>")
    rows = {(r.song_a, r.song_b, r.gap): r for r in op.sample_sweep(df, [("a", "b", "x"), ("a", "c", "y")], [-1.5, -2.0], "note", 3).collect()}
    assert len(rows) == 4 and rows["a", "b", -2.0].score == 9.523 and rows["a", "b", -2.0].exact_share == 0.8  # four equal intervals and one a semitone off
    with pytest.raises(ValueError, match="zz"):
        op.sample_sweep(df, [("a", "zz", "x")], [-2.0], "note")


def test_scores_are_exact_fractions():
    from fractions import Fraction

    # 2 - 2.5 / (1 - 0.126) * d / 6, and 2 - 2.25 / (1 - 0.588) * (1 - shared / joint) - 0.4068
    assert [Fraction(int(x), alignment.UNIT) for x in alignment.INTERVALS[:8]] == [2 - Fraction(2500, 874) * min(Fraction(1), Fraction(d, 6)) for d in range(8)]
    assert Fraction(int(alignment.CHORDS[5][6]), alignment.UNIT) == 2 - Fraction(2250, 412) * Fraction(5, 6) - Fraction(4068, 10000)


@pytest.mark.parametrize("kind", ["note", "chord"])
@pytest.mark.parametrize("method", alignment.METHODS)
def test_lanes_score_as_songs_by_themselves(kind, method):
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 108, n) if kind == "chord" else rng.integers(-300, 300, n) // rng.integers(1, 60, n)
    kernel = alignment.best_scores if method == "smith_waterman" else alignment.end_scores
    wide = set()
    for most in (0, 1, 9, 40, 700):
        seqs, rows = [draw(n) for n in (*rng.integers(0, most + 1, 3), most)], [draw(n) for n in (0, 1, 17, 60)]
        lanes = alignment._Lanes(kind, method, seqs)
        got = alignment.lane_scores(method, rows, lanes)
        wide.add(lanes.dtype)
        for i, a in enumerate(rows):
            for j, b in enumerate(seqs):
                assert got[i, :, j].tolist() == [int(kernel(kind, a, b, np.zeros(len(b), np.int64), 1, t)[0]) for t in range(lanes.shifts)]
    assert wide == ({np.int32, np.int64} if kind == "chord" else {np.int32})


def test_pairs_are_not_moved_to_their_songs(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = leave_one_out(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 4.0)], "song_a string, song_b string, x double"), "x")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_equal_scores_of_shuffles_have_no_spread():
    import pandas as pd

    from cantus.plans.alignment import _permutation_rows

    pdf = pd.DataFrame({"song_a": ["a"], "song_b": ["b"], "symbols_a": [[14] * 7], "symbols_b": [[14, 26, 14] * 3]})
    row = next(_permutation_rows("chord", 20, 42)([pdf])).iloc[0]
    assert row.null_sd == 0 and row.z_score == 0 and row.raw_score == row.null_mean
