"""Queries over the given tables: name -> (spark, sf_dir) -> DataFrame, and their SQL."""
