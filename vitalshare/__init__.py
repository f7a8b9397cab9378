"""Spark-native redistribution of incomplete and ill-defined death records."""
