"""terrace: a Spark-native engine for layered administrative units, their codes, names and changes."""

__version__ = "0.1.0"
