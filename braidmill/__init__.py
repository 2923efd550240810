"""Spark-native reconstruction of variant mixtures from short DNA reads."""
