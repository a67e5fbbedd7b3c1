"""barloom: bar-based time-series features, targets, scores and leaderboards as Spark plans."""
