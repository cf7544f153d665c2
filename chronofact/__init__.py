"""chronofact: interval-stamped evidence facts as Spark DataFrames, and the operators that query them."""

__version__ = "0.1.0"
