"""Spark-native search and analytics over chemical structures and the records that surround them."""
