"""quillstore: keyed binary objects and rows on Spark DataFrames, with batched lookup and diagnostics."""
