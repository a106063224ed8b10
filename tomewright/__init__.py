"""tomewright: catalog and reading-library analytics on Spark DataFrames."""
