"""Spark-native analytics over timed, labelled boxes and event timelines."""
