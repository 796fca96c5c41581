"""Query functions ``(spark, sf_dir) -> DataFrame`` beside the SQL they are checked with."""
