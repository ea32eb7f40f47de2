"""pairloom: aligning pairs of correlated networks with Spark, and the experiments around it."""

__version__ = "0.1.0"
