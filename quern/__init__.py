"""A search and corpus-analytics engine written as Spark plans."""
