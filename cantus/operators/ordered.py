"""Order-dependent operators on songs of any size.

A plain window per song sorts the whole song in one task. Here a song is cut into
blocks of time; a window runs inside (song, block), and what crosses a block border is
carried by summaries of a few rows a block, so a song with a third of all rows spreads
like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_US = 60_000_000


def with_context(df: DataFrame, group: str, at: str, tie: str, value: Column, before: int = 0, after: int = 0, block_us: int = BLOCK_US, running: Column | None = None) -> DataFrame:
    """Adds pos (0-based place in the group by ``at`` then ``tie``), prev and next (arrays of ``value``, nearest first),
    and with ``running`` its sum up to and with the row."""
    df = df.withColumn("_block", F.floor(F.col(at) / block_us).cast("bigint")).withColumn("_value", value)
    order = [F.col(at), F.col(tie)]
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    reach = max(before, after)
    key = F.struct(*order)
    sides = [F.count("*").alias("_n")]
    if running is not None:
        df = df.withColumn("_add", running)
        sides.append(F.sum("_add").alias("_sum"))
    if reach:
        ranked = df.withColumn("_first", F.row_number().over(inside)).withColumn("_last", F.count("*").over(Window.partitionBy(group, "_block")) - F.col("_first") + 1)
        edge = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) <= reach, F.struct(key.alias("k"), F.col("_value").alias("v")))))
        sides += [edge("_first").alias("_heads"), edge("_last").alias("_tails")]
    else:
        ranked = df
    blocks = ranked.groupBy(group, "_block").agg(*sides)
    along = Window.partitionBy(group).orderBy("_block")
    carried = [F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")]
    if before:
        carried.append(F.slice(F.reverse(F.transform(F.flatten(F.collect_list("_tails").over(along.rowsBetween(-before, -1))), lambda x: x.v)), 1, before).alias("_carry_prev"))
    if after:
        carried.append(F.slice(F.transform(F.flatten(F.collect_list("_heads").over(along.rowsBetween(1, after))), lambda x: x.v), 1, after).alias("_carry_next"))
    if running is not None:
        carried.append(F.coalesce(F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry_sum"))
    carry = blocks.select(group, "_block", *carried)
    out = df.withColumn("_rank", F.row_number().over(inside) - 1)
    if before:
        out = out.withColumn("_prev", F.reverse(F.collect_list(F.struct(F.col("_value").alias("v"))).over(inside.rowsBetween(-before, -1))))
    if after:
        out = out.withColumn("_next", F.collect_list(F.struct(F.col("_value").alias("v"))).over(inside.rowsBetween(1, after)))
    out = out.join(carry, [group, "_block"]).withColumn("pos", F.col("_rank") + F.col("_offset"))
    if before:
        out = out.withColumn("prev", F.slice(F.concat(F.transform("_prev", lambda x: x.v), "_carry_prev"), 1, before))
    if after:
        out = out.withColumn("next", F.slice(F.concat(F.transform("_next", lambda x: x.v), "_carry_next"), 1, after))
    if running is not None:
        out = out.withColumn("running", F.sum("_add").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_carry_sum"))
    return out.drop("_add", "_carry_sum", "_block", "_value", "_rank", "_offset", "_prev", "_next", "_carry_prev", "_carry_next")


def interval_as_of(points: DataFrame, intervals: DataFrame, payload: list[str], block_us: int = BLOCK_US) -> DataFrame:
    """Each point (song, onset_us, ...) with the last interval (song, start_us, end_us, payload) that starts at or before it, if it has not ended.

    Half-open: start <= t < end. Of intervals with one start the largest payload is
    last. Points outside every interval keep NULLs. One exchange by song and time
    block; no interval is repeated, however long it is: the last one of every block is
    carried over the blocks behind it, one row a block.
    """
    found = F.struct("start_us", "end_us", *payload)
    block = lambda c: F.floor(F.col(c) / block_us).cast("bigint").alias("_block")
    marks = intervals.where("end_us is not null").select("song", block("start_us"), F.col("start_us").alias("_t"), F.lit(0).alias("_kind"), found.alias("_seg"), F.lit(None).cast(points.schema).alias("_point"))
    asked = points.select("song", block("onset_us"), F.col("onset_us").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_seg"].dataType).alias("_seg"), F.struct(*points.columns).alias("_point"))
    last = marks.groupBy("song", "_block").agg(F.max("_seg").alias("_last_of")).unionByName(asked.groupBy("song", "_block").agg(F.lit(None).cast(marks.schema["_seg"].dataType).alias("_last_of")))
    along = Window.partitionBy("song").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.groupBy("song", "_block").agg(F.max("_last_of").alias("_last_of")).select("song", "_block", F.last("_last_of", ignorenulls=True).over(along).alias("_carried"))
    w = Window.partitionBy("song", "_block").orderBy("_t", "_kind", "_seg").rowsBetween(Window.unboundedPreceding, 0)
    inside = marks.unionByName(asked).withColumn("_inside", F.last("_seg", ignorenulls=True).over(w)).where("_kind = 1")
    joined = inside.join(carry, ["song", "_block"], "left").withColumn("_last", F.coalesce("_inside", "_carried"))
    hit = F.when(F.col("_t") < F.col("_last.end_us"), F.col("_last"))
    return joined.select("_point.*", hit.alias("_hit")).select(*points.columns, *(F.col(f"_hit.{c}").alias(f"seg_{c}") for c in ("start_us", "end_us")), *(F.col(f"_hit.{c}").alias(c) for c in payload))


def densest_windows(points: DataFrame, width_us: int) -> DataFrame:
    """song, from_us, to_us, n: per song the most points within ``width_us`` (closed), from the first to the last of them; the earliest wins.

    A block holds its own points and those up to ``width_us`` after it, so every window
    that starts in a block is whole there.
    """
    own = F.floor(F.col("onset_us") / width_us).cast("bigint")
    spread = points.select("song", "onset_us", F.explode(F.array(own, own - 1)).alias("_block"), own.alias("_own"))
    w = Window.partitionBy("song", "_block").orderBy("onset_us").rangeBetween(0, width_us)
    counted = spread.withColumn("n", F.count("*").over(w)).withColumn("to_us", F.max("onset_us").over(w)).where("_block = _own")
    return counted.groupBy("song").agg(F.max(F.struct(F.col("n"), (-F.col("onset_us")).alias("at"), "to_us")).alias("b")).select("song", (-F.col("b.at")).alias("from_us"), "b.to_us", "b.n")
