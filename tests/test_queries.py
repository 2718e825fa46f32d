"""Every registered core query on the smallest tables, beside its SQL where it has one."""

import os

import duckdb
import pytest

from cantus.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents chord_sequences chord_classes chord_review_candidates other_note_tags gt_annotations k_indie_songs liked_songs".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLE:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cur = db.execute(ORACLE[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        theirs = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
        assert mine == theirs
