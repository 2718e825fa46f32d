"""Problem 3: the first N items of every group.

Simultaneous per-group bisection. An item's code is a vector of components (score,
tie scores, identifier), each larger is better, compared in order; integers and texts
are split into components that doubles hold exactly, so the code keeps every order.
Every round cuts the open interval of each group's current component into sections and
counts the rows above each section bound for all groups at once; the interval shrinks
to the actual values of the one section that holds the cutoff, and where a component is
used up by ties the next one takes over. When a group's cutoff has exactly N rows at or
above it, it is settled. Only rows of open intervals are written again, and each round
joins them with their bounds once; one last join keeps the rows at or above the cutoffs.
No group is ever sorted or brought into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantus.plans.storage import cut, release

SECTIONS = 64
SMALL_GROUPS = 20_000  # bounds of at most so many groups are broadcast
HOT_PARTS = 2_000  # a group with more than this share of all rows is hot: there are fewer than HOT_PARTS of them
PIECE = 6  # bytes of a text that one component holds exactly
BIG = 1.7e308


def _components(df: DataFrame, c: Column) -> list[Column]:
    """Ordered finite doubles in the place of a value: NULL and NaN last, infinities at the ends."""
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c, kind = F.unix_micros(c.cast("timestamp")), T.LongType()
    elif isinstance(kind, T.DateType):
        c, kind = F.unix_date(c), T.IntegerType()
    if isinstance(kind, T.LongType):
        parts = [F.floor(F.call_function("shiftright", c, F.lit(32))).cast("double"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")]
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        longest = df.agg(F.max(F.octet_length(raw))).first()[0] or 0  # one number
        word = lambda k: F.conv(F.rpad(F.hex(F.substring(raw, PIECE * k + 1, PIECE)), 2 * PIECE, "0"), 16, 10).cast("double")
        parts = [*(word(k) for k in range(-(-longest // PIECE))), F.octet_length(raw).cast("double")]
    else:
        x = c.cast("double")
        parts = [F.when(F.isnan(x), None).otherwise(F.greatest(F.least(x, F.lit(BIG)), F.lit(-BIG)))]
    return [F.coalesce(F.when(c.isNotNull(), p), F.lit(-BIG)) for p in parts]


class _Join:
    """Rows joined with one row a group: broadcast for few groups, else by group and salt, hot groups over as many salts as they have parts."""

    def __init__(self, sizes: DataFrame):
        total = sizes.agg(F.sum("inside")).first()[0] or 0  # one number
        part = max(1, -(-total // HOT_PARTS))
        # fewer than HOT_PARTS rows, since each has more than a part of the total
        self.hot = F.broadcast(cut(sizes.where(F.col("inside") > part).select("group_key", F.ceil(F.col("inside") / part).cast("int").alias("salts"))))

    def __call__(self, rows: DataFrame, groups: DataFrame, n_groups: int, how: str = "inner") -> DataFrame:
        if n_groups <= SMALL_GROUPS:
            return rows.join(F.broadcast(groups), "group_key", how)
        salts = F.coalesce("salts", F.lit(1))
        rows = rows.join(self.hot, "group_key", "left").withColumn("salt", F.pmod(F.xxhash64("item_key"), salts).cast("int")).drop("salts")
        groups = groups.join(self.hot, "group_key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return rows.join(groups, ["group_key", "salt"], how).drop("salt")


def top_n(items: DataFrame, group: str, code: list[Column], item: str, n: int) -> DataFrame:
    """group_key, item_key, code of the first ``n`` rows of each group, by the code components, larger first.

    An item counts once in its group, with its best code; items equal in every component
    are ordered by their identifier, larger first, so each group gives exactly its size
    or ``n`` rows. Integers and texts of any size are compared exactly, decimals as
    doubles. NULL groups are no group. A NULL or NaN component ranks last, a NULL item
    is an item. ``code`` begins with one element per component, as doubles.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    parts = [p for c in (*code, F.col(item)) for p in _components(items, c)]
    k = len(parts)
    rows = items.where(F.col(group).isNotNull()).select(F.col(group).alias("group_key"), F.col(item).alias("item_key"), F.array(*parts).alias("code"))
    rows = cut(rows.groupBy("group_key", "item_key").agg(F.max("code").alias("code")))
    sizes = cut(rows.groupBy("group_key").agg(F.count("*").alias("inside"), F.min(F.get("code", F.lit(0))).alias("lo"), F.max(F.get("code", F.lit(0))).alias("hi")))
    joined = _Join(sizes)
    bounds = sizes.where(F.col("inside") > n).select("group_key", F.lit(0).alias("level"), F.lit(n).cast("bigint").alias("need"), F.array().cast("array<double>").alias("prefix"), "lo", "hi")
    open_rows, settled, of_round = rows, [], None
    groups = bounds.count()
    large = groups
    while groups:
        value = F.get("code", F.col("level"))
        inside = (F.slice("code", 1, F.col("level")) == F.col("prefix")) & value.between(F.col("lo"), F.col("hi"))
        half = F.col("hi") / 2 - F.col("lo") / 2
        section = F.when(half <= 0, F.lit(0)).otherwise(F.least(F.floor((value / 2 - F.col("lo") / 2) / half * SECTIONS), F.lit(SECTIONS - 1))).cast("int")
        placed = cut(joined(open_rows, bounds, groups).where(inside).select("group_key", "item_key", "code", "level", section.alias("section")))
        if of_round is not None:
            release(of_round)
        # one pass: per group and section the number of rows and the actual range of values
        following = F.get("code", F.col("level") + 1)
        counts = placed.groupBy("group_key", "section").agg(F.count("*").alias("rows"), F.min(value).alias("s_lo"), F.max(value).alias("s_hi"), F.min(following).alias("n_lo"), F.max(following).alias("n_hi"))
        per_group = counts.groupBy("group_key").agg(F.collect_list(F.struct("section", "rows", "s_lo", "s_hi", "n_lo", "n_hi")).alias("s")).join(bounds, "group_key")  # at most SECTIONS entries
        above = lambda x: F.aggregate(F.filter("s", lambda y: y.section > x.section), F.lit(0).cast("bigint"), lambda a, y: a + y.rows)
        # the section that holds the n-th row
        per_group = per_group.withColumn("hit", F.get(F.filter("s", lambda x: (above(x) < F.col("need")) & (above(x) + x.rows >= F.col("need"))), F.lit(0)))
        per_group = per_group.withColumn("left", F.col("need") - above(F.col("hit")))
        tied = F.col("hit.s_lo") == F.col("hit.s_hi")
        done = (F.col("hit.rows") == F.col("left")) | (tied & (F.col("level") >= k - 1))
        upto = F.concat("prefix", F.array(F.col("hit.s_lo")))
        decided = cut(
            per_group.select(
                "group_key", F.when(done, upto).alias("cutoff"), F.when(tied, F.col("level") + 1).otherwise(F.col("level")).alias("level"), F.col("left").alias("need"), F.when(tied, upto).otherwise(F.col("prefix")).alias("prefix"),
                F.when(tied, F.col("hit.n_lo")).otherwise(F.col("hit.s_lo")).alias("lo"), F.when(tied, F.col("hit.n_hi")).otherwise(F.col("hit.s_hi")).alias("hi"),
            )
        )
        settled.append(decided.where("cutoff is not null").select("group_key", "cutoff"))
        bounds = decided.where("cutoff is null").drop("cutoff")
        open_rows, of_round = placed.select("group_key", "item_key", "code"), placed
        groups = bounds.count()
    if of_round is not None:
        release(of_round)
    if not settled:
        return rows
    cutoffs = settled[0]
    for x in settled[1:]:
        cutoffs = cutoffs.unionByName(x)
    # groups without a cutoff have at most n rows
    kept = joined(rows, cutoffs, large, "left").where(F.col("cutoff").isNull() | (F.slice("code", 1, F.size("cutoff")) >= F.col("cutoff")))
    return kept.select("group_key", "item_key", "code")


def review_first(candidates: DataFrame, n: int = 5) -> DataFrame:
    """song, place, segment_index, density, n_notes: each song's first ``n`` segments to review.

    Higher density first, then more notes, then earlier onset, then the smaller
    segment_index. A segment counts once, with its latest delivery (equal times: the
    larger density, then n_notes). Rows without song, onset or segment_index and rows
    whose density is NULL or NaN are no candidates.
    """
    df = candidates.select("song", "segment_index", "segment_onset", "n_notes", "density", "loaded_at")
    df = df.where(F.col("song").isNotNull() & F.col("segment_onset").isNotNull() & ~F.isnan("segment_onset") & F.col("segment_index").isNotNull())
    order = F.struct(F.col("loaded_at"), F.nanvl("density", F.lit(None)), F.col("n_notes"), F.col("segment_onset"))
    df = df.groupBy("song", F.col("segment_index").cast("bigint").alias("segment_index")).agg(F.max_by(F.struct("density", "n_notes", "segment_onset"), order).alias("r")).select("song", "segment_index", "r.*")
    df = df.where(F.col("density").isNotNull() & ~F.isnan("density"))
    best = top_n(df, "song", [F.col("density"), F.col("n_notes"), -F.col("segment_onset"), -F.col("segment_index")], "segment_index", n)
    # at most n rows a song from here on
    ordered = best.groupBy("group_key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("code", "item_key")))).alias("r"))
    placed = ordered.select(F.col("group_key").alias("song"), F.posexplode("r").alias("at", "x"))
    return placed.select("song", (F.col("at") + 1).cast("bigint").alias("place"), F.col("x.item_key").alias("segment_index"), F.col("x.code")[0].alias("density"), (F.col("x.code")[1] * 2.0**32 + F.col("x.code")[2]).try_cast("bigint").alias("n_notes"))
