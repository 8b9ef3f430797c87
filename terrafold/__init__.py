"""terrafold: a Spark-native analytics engine for point-based daily climate series."""

__version__ = "0.1.0"
