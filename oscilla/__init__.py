"""Movement-signal analytics on Spark: recordings in, cohort results out."""

__all__ = ["config", "session"]
