"""One-to-one matching of two sets of timed notes within a tolerance.

Rows farther apart than the tolerance never meet, so each group is cut wherever the
time line is silent for longer; the pieces are small whatever the size of the song.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.operators.ordered import with_context


def pieces(rows: DataFrame, tolerance_us: int) -> DataFrame:
    """Adds piece: rows of one song in different pieces are more than the tolerance apart."""
    df = with_context(rows, "song", "onset_us", "id", F.col("onset_us"), before=1)
    start = F.when(F.size("prev") == 0, 1).when(F.col("onset_us") - F.get("prev", F.lit(0)) > tolerance_us, 1).otherwise(0)
    df = df.withColumn("_start", start).drop("pos", "prev")
    return with_context(df, "song", "onset_us", "id", F.lit(1), running=F.col("_start")).withColumnRenamed("running", "piece").drop("_start", "pos")


def maximum_matching(edges: dict[int, list[int]]) -> dict[int, int]:
    """Right to left partners of a maximum matching, by augmenting paths without recursion."""
    owner: dict[int, int] = {}
    for root in edges:
        parent: dict[int, tuple[int, int | None]] = {}
        stack, seen, end = [(root, None)], set(), None
        while stack and end is None:
            left, via = stack.pop()
            for right in edges[left]:
                if right in seen:
                    continue
                seen.add(right)
                parent[right] = (left, via)
                if right not in owner:
                    end = right
                    break
                stack.append((owner[right], right))
        while end is not None:
            left, via = parent[end]
            owner[end] = left
            end = via
    return owner


PIECES = 256  # pieces in one Python call; each is small, so a call is bounded too


def _by_piece(pdf: pd.DataFrame) -> list[tuple[list[tuple], list[tuple]]]:
    """(reference rows, estimated rows) of every piece, as (onset, offset, pitch)."""
    out: dict[int, tuple[list, list]] = {}
    columns = [pdf[c].tolist() if c in pdf else [None] * len(pdf) for c in ("piece", "side", "onset_us", "offset_us", "pitch")]
    for piece, side, on, off, pitch in zip(*columns):
        out.setdefault(piece, ([], []))[side].append((on, off, pitch))
    return [(sorted(a, key=lambda x: x[0]), sorted(b, key=lambda x: x[0])) for a, b in out.values()]


def _match(tolerance_us: int, pitched: bool, ratio: float | None):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        matched = 0
        for ref, est in _by_piece(pdf):
            edges = {}
            for i, (on, off, pitch) in enumerate(ref if est else []):
                near = [j for j, e in enumerate(est) if abs(e[0] - on) <= tolerance_us and (not pitched or e[2] == pitch) and (ratio is None or abs(e[1] - off) <= max(tolerance_us, ratio * (off - on)))]
                if near:
                    edges[i] = near
            matched += len(maximum_matching(edges))
        return pd.DataFrame({"song": [pdf["song"].iloc[0]], "matched": [matched]})

    return group


def matched_counts(reference: DataFrame, estimate: DataFrame, tolerance_us: int = 50_000, pitched: bool = False, ratio: float | None = None) -> DataFrame:
    """song, n_ref, n_est, matched: the size of a maximum one-to-one matching of (song, id, onset_us, offset_us, pitch)."""
    cols = ("song", "id", "onset_us", "offset_us", "pitch")
    both = reference.select(*cols).withColumn("side", F.lit(0)).unionByName(estimate.select(*cols).withColumn("side", F.lit(1)))
    hits = pieces(both, tolerance_us).groupBy("song", F.expr(f"piece div {PIECES}")).applyInPandas(_match(tolerance_us, pitched, ratio), "song string, matched bigint")
    sizes = both.groupBy("song").agg(F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_est"))
    return sizes.join(hits.groupBy("song").agg(F.sum("matched").alias("matched")), "song")


def f_measure(counts: DataFrame) -> DataFrame:
    p, r = F.try_divide("matched", "n_est"), F.try_divide("matched", "n_ref")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("song", "n_ref", "n_est", "matched", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f_measure"))


def _greedy(tolerance_us: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        gained = lost = kept = 0
        for old, new in _by_piece(pdf):
            free = [True] * len(new)
            for on, _, pitch in old:
                near = [(abs(e[0] - on), j) for j, e in enumerate(new) if free[j] and e[2] == pitch and abs(e[0] - on) < tolerance_us]
                if near:
                    free[min(near)[1]] = False
                    kept += 1
                else:
                    lost += 1
            gained += sum(free)
        return pd.DataFrame({"song": [pdf["song"].iloc[0]], "kept": [kept], "lost": [lost], "gained": [gained]})

    return group


def note_changes(old: DataFrame, new: DataFrame, tolerance_us: int = 50_000) -> DataFrame:
    """song, kept, lost, gained: old notes in time order each take the nearest free new note of their pitch (ties: the earlier)."""
    cols = ("song", "id", "onset_us", "pitch")
    both = old.select(*cols).withColumn("side", F.lit(0)).unionByName(new.select(*cols).withColumn("side", F.lit(1)))
    hits = pieces(both, tolerance_us).groupBy("song", F.expr(f"piece div {PIECES}")).applyInPandas(_greedy(tolerance_us), "song string, kept bigint, lost bigint, gained bigint")
    return hits.groupBy("song").agg(*(F.sum(c).alias(c) for c in ("kept", "lost", "gained")))
