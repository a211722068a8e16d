"""markloom: Markdown analytics for Spark, declared over DataFrames."""
