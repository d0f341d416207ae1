"""A PySpark library for feature engineering over large collections of long texts."""
