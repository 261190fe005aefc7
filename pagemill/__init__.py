"""pagemill: keyed lookup, page decoding and activity profiles as Spark jobs."""
