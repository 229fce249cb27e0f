"""quillforge: corpus and recognition-quality analytics written for Spark DataFrames."""
