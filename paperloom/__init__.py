"""Searching and analysing an archive of examination papers and notes, as Spark jobs."""
