"""python -m cantus QUERY TABLES [OUT]: run one core query and show it, or write it as Parquet."""

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> None:
    from cantus.plans.queries import QUERIES

    if len(args) not in (2, 3) or args[0] not in QUERIES:
        sys.exit(f"{__doc__}\nQueries: {' '.join(sorted(QUERIES))}")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[args[0]](spark, args[1])
    df.write.mode("overwrite").parquet(args[2]) if len(args) == 3 else df.show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
