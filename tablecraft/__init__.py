"""Build and maintain analytics tables with Spark DataFrames on plain parquet."""

__version__ = "0.1.0"
