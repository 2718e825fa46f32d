"""Problem 1: runs of the same chord as single events.

Associative run summaries. The segments are range-sorted by song and time, so a song
of any size is spread over chunks. Each chunk encodes its runs locally; only its
first and last run can continue elsewhere. Those boundary runs form a monoid and are
merged level by level with a fixed fan-in, so no task sees more than ``2 * FAN`` of
them, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.llm.segments import in_order
from cantus.plans.storage import cut

FAN = 64
RUN = ["song", "mask", "class_name", "first_index", "last_index", "n_segments", "start_sec", "end_sec", "sounding_sec"]
SCHEMA = "song string, mask int, class_name string, first_index bigint, last_index bigint, n_segments bigint, start_sec double, end_sec double, sounding_sec double, chunk bigint, is_first boolean, is_last boolean"


def _joins(song_a, mask_a, song_b, mask_b) -> bool:
    return song_a == song_b and mask_a == mask_b and mask_a >= 0


def _merge(a: dict, b: dict) -> dict:
    """The associative operation on two adjacent compatible runs."""
    ends = [x for x in (a["end_sec"], b["end_sec"]) if x == x and x is not None]
    return a | {"class_name": a["class_name"] or b["class_name"], "last_index": b["last_index"], "n_segments": a["n_segments"] + b["n_segments"], "end_sec": max(ends, default=None), "sounding_sec": a["sounding_sec"] + b["sounding_sec"]}


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run-length encoding of one sorted chunk, batch by batch; one run stays open between batches."""
    chunk = TaskContext.get().partitionId()
    open_run: dict | None = None
    first = True

    def out(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
        nonlocal first
        rows = rows.assign(chunk=chunk, is_first=False, is_last=False)
        if first and len(rows):
            rows.loc[rows.index[0], "is_first"] = True
            first = False
        if last:
            rows.loc[rows.index[-1], "is_last"] = True
        rows["mask"] = rows["mask"].where(rows["mask"] >= 0).astype("Int32")
        return rows

    for pdf in batches:
        if not len(pdf):
            continue
        song, mask = pdf["song"].to_numpy(), pdf["mask"].fillna(-1).to_numpy().astype("int64")
        new = np.ones(len(pdf), bool)
        new[1:] = (song[1:] != song[:-1]) | (mask[1:] != mask[:-1]) | (mask[1:] < 0)
        at = np.flatnonzero(new)
        length = pdf["duration"].where(pdf["duration"].notna(), pdf["end_sec"] - pdf["start_sec"]).fillna(0.0).to_numpy()
        to = np.append(at[1:], len(pdf)) - 1
        index = pdf["segment_index"].to_numpy()
        end = np.fmax.reduceat(pdf["end_sec"].to_numpy(dtype="float64"), at)
        names = pdf["class_name"].to_numpy()
        runs = pd.DataFrame({"song": song[at], "mask": mask[at], "class_name": names[at], "first_index": index[at], "last_index": index[to], "n_segments": to - at + 1, "start_sec": pdf["start_sec"].to_numpy()[at], "end_sec": end, "sounding_sec": np.add.reduceat(length, at)})
        if open_run is not None:
            head = runs.iloc[0].to_dict()
            if _joins(open_run["song"], open_run["mask"], head["song"], head["mask"]):
                merged = _merge(open_run, head)
                runs = pd.concat([pd.DataFrame([merged]), runs.iloc[1:]], ignore_index=True)
            else:
                runs = pd.concat([pd.DataFrame([open_run]), runs], ignore_index=True)
        open_run = runs.iloc[-1].to_dict()
        if len(runs) > 1:
            yield out(runs.iloc[:-1], False)
    if open_run is not None:
        yield out(pd.DataFrame([open_run]), True)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the boundary runs of FAN neighbouring chunks; the block's own ends stay boundary runs."""
    rows = pdf.sort_values(["chunk", "is_last"], kind="stable").to_dict("records")
    done: list[dict] = []
    for r in rows:
        r["mask"] = -1 if pd.isna(r["mask"]) else int(r["mask"])
        # a run may only join the one before it if nothing lies between: the last of one chunk, the first of the next
        if done and done[-1]["is_last"] and r["is_first"] and _joins(done[-1]["song"], done[-1]["mask"], r["song"], r["mask"]):
            done[-1] = _merge(done[-1], r) | {"is_last": r["is_last"]}
        else:
            done.append(r)
    n = len(done)
    out = pd.DataFrame(done).assign(chunk=rows[0]["chunk"] // FAN, is_first=[i == 0 for i in range(n)], is_last=[i == n - 1 for i in range(n)])
    out["mask"] = out["mask"].where(out["mask"] >= 0).astype("Int32")
    return out


def chord_runs(segments: DataFrame) -> DataFrame:
    """All runs of ``segments`` (as ``identified`` returns them), single segments included.

    A segment without a set (mask NULL) is a run of its own and never joins another.
    Missing numbers and pauses do not break a run. sounding_sec adds the durations
    (end minus start where NULL, 0 where neither is known); an empty input gives no
    rows. Order is (start_sec, segment_index), so ties in time are settled.
    """
    local = cut(in_order(segments).mapInPandas(_local, SCHEMA))
    parts = max(2, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = local.where("is_first or is_last")
    parts_of_result = [local.where("not is_first and not is_last")]
    while True:
        merged = level.groupBy(F.expr(f"chunk div {FAN}")).applyInPandas(_block, SCHEMA)
        parts = -(-parts // FAN)
        if parts <= 1:
            parts_of_result.append(merged)
            break
        merged = cut(merged)
        parts_of_result.append(merged.where("not is_first and not is_last"))
        level = merged.where("is_first or is_last")
    result = parts_of_result[0]
    for x in parts_of_result[1:]:
        result = result.unionByName(x)
    return result.select(*RUN)


def found(runs: DataFrame) -> DataFrame:
    """Maximal runs of two or more segments of one known set."""
    return runs.where("mask is not null and n_segments >= 2").select("song", "first_index", "last_index")
