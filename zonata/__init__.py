"""Spark-native analytics for spatial gradients in tissue images."""
