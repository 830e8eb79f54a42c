"""A PySpark-native analytics engine for credit-risk scorecards."""
