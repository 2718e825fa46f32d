"""Problem 4: pairs of records by nearest time within a tolerance.

Expanding-ring joins. The first ring joins each left row with its own and the two
adjacent cells of the finest grid. A match no farther than one cell width is provably
the nearest, since every row within that distance lies in the three cells. The other
left rows go on to a grid of twice the width, up to the tolerance. Cells are keyed by
song and time, so a song of any size spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.plans.storage import cut

MICROS = 1_000_000


def nearest(left: DataFrame, right: DataFrame, tolerance: float = 0.05, halvings: int = 3) -> DataFrame:
    """left_id, right_id, distance_us for the nearest right row of each left row within ``tolerance`` seconds.

    Both sides have (entity, at, id); at is in seconds and read to the microsecond, so
    equal distances are equal. Of equally near rows the earlier, then the smaller id
    wins. NULL, NaN and infinite times, NULL entities and NULL ids match nothing.
    Repeated ids with the same time are one row; a right row may serve several.
    """
    def clean(df: DataFrame, id_name: str) -> DataFrame:
        us = F.round(F.col("at") * MICROS).try_cast("bigint")
        return df.where(F.col("entity").isNotNull() & F.col("id").isNotNull() & F.col("at").isNotNull() & ~F.isnan("at") & (F.abs("at") < 9e12)).select(F.col("entity"), us.alias(f"{id_name}_us"), F.col("id").alias(f"{id_name}_id"))

    left = clean(left, "left").groupBy("left_id").agg(F.min(F.struct("left_us", "entity")).alias("x")).select("left_id", "x.entity", "x.left_us")
    left = cut(left)
    # only entities that have a left row, and only what the joins need
    right = cut(clean(right, "right").join(left.select("entity").distinct(), "entity", "left_semi").dropDuplicates(["entity", "right_us", "right_id"]))
    limit = round(tolerance * MICROS)
    width = max(1, -(-limit // 2**halvings))
    waiting, done = left, []
    while True:
        last = width >= limit
        cell = lambda c: F.floor(F.col(c) / width).cast("bigint")  # noqa: E731,B023
        ring = waiting.withColumn("cell", F.explode(F.array(*(cell("left_us") + i for i in (-1, 0, 1)))))
        pairs = ring.join(right.withColumn("cell", cell("right_us")), ["entity", "cell"])
        reach = min(width, limit)
        best = pairs.where(F.abs(F.col("left_us") - F.col("right_us")) <= reach).groupBy("left_id").agg(F.min(F.struct(F.abs(F.col("left_us") - F.col("right_us")).alias("distance_us"), "right_us", "right_id")).alias("b"))
        best = cut(best.select("left_id", "b.right_id", "b.distance_us"))
        done.append(best)
        if last:
            break
        waiting = cut(waiting.join(best.select("left_id"), "left_id", "left_anti"))
        width = min(2 * width, limit)
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result


def annotations_to_notes(annotations: DataFrame, notes: DataFrame, tolerance: float = 0.05, stem: str = "other") -> DataFrame:
    """annotation_id, note_id, distance_us: every annotation of ``stem`` (any spelling) with its nearest note of the song."""
    spelled = F.regexp_replace(F.lower("stem"), r"[^\p{L}\p{N}]", "")
    left = annotations.where(spelled == stem).select(F.col("song").alias("entity"), F.col("onset").alias("at"), F.col("annotation_id").alias("id"))
    right = notes.select(F.col("song").alias("entity"), F.col("onset").alias("at"), F.col("note_id").alias("id"))
    return nearest(left, right, tolerance).select(F.col("left_id").alias("annotation_id"), F.col("right_id").alias("note_id"), "distance_us")
