"""tidemill: a Spark-native engine for analysing and searching short documents."""

__version__ = "0.1.0"
