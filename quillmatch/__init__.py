"""A PySpark engine for fuzzy retrieval over large collections of text segments."""
