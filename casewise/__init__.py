"""Process-mining analytics on Spark DataFrames and streams."""

from casewise.config import Config

__all__ = ["Config"]
