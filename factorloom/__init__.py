"""Factor research and backtests as Spark jobs."""
