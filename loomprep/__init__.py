"""Spark-native table profiling, cleaning, modelling and replay."""

from loomprep.session import build_session

__all__ = ["build_session"]
