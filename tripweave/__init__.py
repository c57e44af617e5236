"""Travel diaries from GPS points, as Spark DataFrame operators."""
