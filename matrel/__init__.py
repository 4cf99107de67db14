"""matrel: a Spark-first engine for keyed matrix tables, statistics, factor algebra and graphs."""
