"""Broadsheet: cleaning, indexing and searching news collections as Spark jobs."""
