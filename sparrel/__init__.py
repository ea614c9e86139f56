"""Cross-modal retrieval and evaluation on Spark DataFrames."""
