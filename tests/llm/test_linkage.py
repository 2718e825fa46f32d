"""Matching recordings on hand-written rows."""

import os

import pytest
from pyspark.sql import functions as F

from cantus.llm import linkage as L

SF = "/root/testdata/sf0.01"
SCHEMA = "row_id string, title string, artist string, artists_all array<string>, album string, duration_ms bigint, key string, weight string, base string"
LEFT = [
    ("k1", "Silver Orchard", "Rulraeng Pumgae", "Weightless Ocean", 248198),
    ("k2", "먼 달빛", "캉룰 뭄품", "Broken Garden", 217123),
    ("k3", "Rusty Planet", "Ranchan Ramcheom", "젖은 가로등", 267837),
    ("k4", "Rusty Planet - Demo", "Ranchan Ramcheom", None, 227376),
    ("k5", "38 Gardens", "The Supung & Jeombun", None, 220867),
    ("k6", "39 Gardens", "The Supung & Jeombun", None, 221000),
    ("k7", "Last Compass to Ferry (Feat. Someone Else)", "Faded Gaenggae", "푸른 여름", 176050),
    ("k8", None, "Nobody", None, None),
    ("k9", "Ocean", None, None, 1000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, a, [a] if a else None, al, d, "x", "y", "z") for i, t, a, al, d in rows], SCHEMA)


def test_links_through_every_kind_of_dress(spark):
    right = [
        ("l1", "SILVER ORCHARD (Lyrics)", "RulraengPumgae", None, None),
        ("l2", "[MV] Kangrul Mumpum _ Meon Dalbit", "Plainfield Sounds", "Broken Garden - EP", 217000),
        ("l3", "Ranchan Ramcheom", "Rusty Plaent", None, 268),  # fields swapped, a slip, seconds
        ("l4", "Ranchan Ramcheom 「Rusty Planet (Demo)」", "Haru Cassette TV", None, 227376),
        ("l5", "39  gardens M/V", "Supung and Jeombun, The", None, 221000),
        ("l6", "Last Compass t…", "Faded Gaenggae - Topic", "푸른 여름", 176000),
        ("l7", "Silver Orchard", "Another Band", "Weightless Ocean", 248198),  # an equal title of another artist
        ("l8", "Silver Orchard (Live)", "Rulraeng Pumgae", None, 248198),  # another version
        ("l9", None, None, None, None),
        ("l10", "Rusty Planet | official video", "Ranchan Ramcheom Official", None, None),
    ]
    got = {(r.left_id, r.right_id) for r in L.link(frame(spark, LEFT + LEFT[:2]), frame(spark, right + right[:3]))[0].collect()}
    assert got == {("k1", "l1"), ("k2", "l2"), ("k3", "l3"), ("k4", "l4"), ("k6", "l5"), ("k7", "l6"), ("k3", "l10")}


def test_confidences_are_refined_until_they_settle(spark, monkeypatch):
    rounds, write = [], L.cut

    def restless(df):
        if "moved" in df.columns:
            rounds.append(1)
            if len(rounds) < 15:  # not settled before the fifteenth round
                df = df.withColumn("moved", F.lit(1.0))
        return write(df)

    monkeypatch.setattr(L, "cut", restless)
    assert L.link(frame(spark, LEFT[:3]), frame(spark, LEFT[:3]))[0].count() == 3
    assert len(rounds) == 15


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_confidences_held_at_the_ends_of_the_scale_settle(spark, monkeypatch):
    moved, write = [], L.cut

    def counted(df):
        out = write(df)
        if "moved" in df.columns:
            moved.append(out.agg(F.max("moved")).first()[0])
            assert len(moved) < 60
        return out

    monkeypatch.setattr(L, "cut", counted)
    L.same_recordings(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("k_indie_songs", "liked_songs")))
    assert moved[-1] < 1e-5


AMBIGUOUS = ["Silver Orchard", "Velvet Harbor", "Paper Lantern", "Hollow Compass", "Quiet Engine"]


def test_neighbours_decide_an_ambiguous_pair(spark):
    """Two spellings of one artist and a length that speaks against it: alone no match, beside other songs of both spellings one."""
    left = [(f"k{i}", t, "Xmarigoldband", None, 200_000 + 9000 * i) for i, t in enumerate(AMBIGUOUS)]
    right = [(f"l{i}", t, "Marigoldbandx", None, 200_000 + 9000 * i + (8000 if i == 0 else 0)) for i, t in enumerate(AMBIGUOUS)]
    match = lambda n, **kw: {(r.left_id, r.right_id) for r in L.link(frame(spark, left[:n]), frame(spark, right[:n]), **kw)[0].collect()}
    assert match(1) == set()
    assert match(5) == {(f"k{i}", f"l{i}") for i in range(5)}
    assert match(5, rounds=0) == {(f"k{i}", f"l{i}") for i in range(1, 5)}


def test_copies_on_either_side_lose_no_link(spark):
    left = [("k1", *LEFT[0][1:]), ("k1b", *LEFT[0][1:]), LEFT[1]]
    right = [(f"l{i}", *LEFT[0][1:]) for i in range(3)] + [("m", "Silver Orchard", "Rulraeng Pumgae", None, None)]
    got = {(r.left_id, r.right_id) for r in L.link(frame(spark, left), frame(spark, right))[0].collect()}
    assert got == {(a, b) for a in ("k1", "k1b") for b in ("l0", "l1", "l2", "m")}


def test_whole_titles_share_no_key_of_cut_ones():
    assert not L._starts("a", "silverorchard", "", False, "l") & L._starts("a", "silverlake", "", False, "r")
    for sides in (("l", "r"), ("r", "l")):
        assert L._starts("a", "silverorchard", "", False, sides[0]) & L._starts("a", "silveror", "", True, sides[1])
        assert L._starts("a", "silverorch", "", True, sides[0]) & L._starts("a", "silver", "", True, sides[1])


def test_links_of_nothing(spark):
    df = frame(spark, LEFT)
    assert L.link(df.limit(0), df)[0].count() == 0
    assert L.link(df, df.limit(0))[0].count() == 0


def test_names():
    assert L.squeeze("투명한 바다") == "tumyeonghanbada"
    assert L.squeeze("Don't Waké thé") == "dontwakethe"
    assert L.artist_key("Seolbil & Meoltaem, The") == L.artist_key("The Seolbil and Meoltaem")
    assert L.slips("harbor", "habror") == 1 and L.slips("harbor", "harbour") == 1 and L.slips("abc", "xyz") == 3
    assert L.alike("38gardens", "39gardens") == 0.0
    assert L.undress("Kite (Electric Compass) (Demo)") == ("Kite (Electric Compass)", "demo")
    assert L.undress("먼 기차 - Acoustic Ver.") == ("먼 기차", "acoustic")
    assert L.seconds(245) == 245 and L.seconds(245_000) == 245 and L.seconds(None) is None and L.seconds(-1) is None


def test_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    plans, write = [], L.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(L, "cut", seen)
    matches, _ = L.link(frame(spark, LEFT), frame(spark, LEFT))
    plans.append(matches._jdf.queryExecution().executedPlan().toString())
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    assert sum("SortMergeJoin" in p for p in plans) >= 6
