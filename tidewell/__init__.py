"""Storage-level telemetry analytics on Spark: cleaning, features, models, rules, balances, streams."""

__version__ = "0.1.0"
