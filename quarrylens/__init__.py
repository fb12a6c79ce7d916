"""Spark-native analytics over source-code index tables."""

from quarrylens.runtime import load, materialize, session

__all__ = ["load", "materialize", "session"]
