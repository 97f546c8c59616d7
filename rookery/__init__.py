"""Chess analytics on Spark: games as compact move strings, everything else as Catalyst expressions."""
