"""Point-in-time panels, event studies and table operators as PySpark DataFrame jobs."""
