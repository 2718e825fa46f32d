"""Chord classes, pitch-class sets as 12-bit masks, and chord scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class name, common name, pitch classes on root 0.
CHORD_CLASSES = [
    ("3-11B", "major triad", (0, 4, 7)),
    ("4-26", "minor seventh chord", (0, 3, 7, 10)),
    ("3-11A", "minor triad", (0, 3, 7)),
    ("4-20", "major seventh chord", (0, 4, 7, 11)),
    ("4-27B", "dominant seventh chord", (0, 4, 7, 10)),
    ("4-27A", "half-diminished seventh chord", (0, 3, 6, 10)),
    ("3-12", "augmented triad", (0, 4, 8)),
    ("4-22A", "major-second major tetrachord", (0, 2, 4, 7)),
    ("3-10", "diminished triad", (0, 3, 6)),
]
# Scoring constants.
MATCH_SCORE = 2.0
CORPUS_MEAN_JACCARD = 0.588
CHORD_RANDOM_SCORE = -0.25
ROOT_BONUS = 3.0
ROOT_CORRECTION = 0.4068
GAP = -2.0
INTERVAL_WINDOW = 6
CORPUS_MEAN_INTERVAL = 0.126
NOTE_RANDOM_SCORE = -0.5

CHORD_SLOPE = (MATCH_SCORE - CHORD_RANDOM_SCORE) / (1 - CORPUS_MEAN_JACCARD)
CHORD_OFFSET = CHORD_SLOPE - MATCH_SCORE
NOTE_SLOPE = (MATCH_SCORE - NOTE_RANDOM_SCORE) / (1 - CORPUS_MEAN_INTERVAL)
NOTE_OFFSET = NOTE_SLOPE - MATCH_SCORE


def mask_of(pcs) -> int:
    return sum(1 << (p % 12) for p in set(pcs))


ZERO_MASKS = [mask_of(pcs) for _, _, pcs in CHORD_CLASSES]


def rotate(mask, root):
    """Transpose a 12-bit mask up by ``root`` (Columns)."""
    return ((F.call_function("shiftleft", mask, root)).bitwiseOR(F.call_function("shiftright", mask, F.lit(12) - root))).bitwiseAND(F.lit(4095))


def parse_set(text: Column) -> Column:
    """Mask of a written pitch-class set in any order and spacing; NULL when it names no number."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    bits = F.aggregate(numbers, F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.pmod(x.try_cast("bigint"), F.lit(12)).cast("int"))))
    return F.when(F.size(numbers) > 0, bits)


def normal_class(text: Column) -> Column:
    """A class name in the spelling of the class table, whatever its case, spaces or dash sign."""
    part = lambda g: F.regexp_extract(F.upper(text), r"(\d+)[^0-9A-Z]+(\d+)[^0-9A-Z]*([AB]?)", g)
    return F.when(part(1) != "", F.concat(part(1), F.lit("-"), part(2), part(3)))


def set_text(mask: Column) -> Column:
    """``0,4,7`` for a mask."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    return F.array_join(F.transform(bits, lambda i: i.cast("string")), ",")


def zero_masks(spark: SparkSession, classes: DataFrame | None = None) -> DataFrame:
    """class_name, zero_mask: from a class table (nine fixed rows) or the built-in values."""
    if classes is None:
        return spark.createDataFrame([(c, m) for (c, _, _), m in zip(CHORD_CLASSES, ZERO_MASKS)], "class_name string, zero_mask int")
    return classes.select(normal_class(F.col("forte_class")).alias("class_name"), parse_set(F.col("root_zero_set")).alias("zero_mask")).dropna().dropDuplicates(["class_name"])


def absolute_masks(zero: DataFrame) -> DataFrame:
    """mask, class_of_mask, root_of_mask: at most 12 rows a class; a symmetric set takes its lowest root."""
    rolled = zero.withColumn("root", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("mask", rotate(F.col("zero_mask"), F.col("root")))
    return rolled.groupBy("mask").agg(F.min_by(F.struct("class_name", "root"), F.struct("root", "class_name")).alias("x")).select("mask", F.col("x.class_name").alias("class_of_mask"), F.col("x.root").alias("root_of_mask"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint pitch classes of two masks."""
    return F.bit_count(a.bitwiseAND(b)) / F.bit_count(a.bitwiseOR(b))


def chord_substitution(a: Column, b: Column) -> Column:
    return F.lit(CHORD_SLOPE) * jaccard(a, b) - F.lit(CHORD_OFFSET)


def compound_score(a: Column, root_a: Column, b: Column, root_b: Column) -> Column:
    return chord_substitution(a, b) - F.lit(ROOT_CORRECTION) + F.when(root_a == root_b, F.lit(ROOT_BONUS)).otherwise(0.0)


def interval_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.lit(float(INTERVAL_WINDOW)))


def interval_substitution(a: Column, b: Column) -> Column:
    return F.lit(NOTE_SLOPE) * interval_similarity(a, b) - F.lit(NOTE_OFFSET)
