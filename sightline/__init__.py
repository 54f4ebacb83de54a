"""Spark-native analytics over scored detections."""
