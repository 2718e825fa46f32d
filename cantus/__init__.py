"""cantus: a Spark-first engine for symbolic-music tables."""
