"""Evidence-scored document analytics on Spark DataFrames."""
