"""Spark-native document auditing: text repair, extraction, duplicates, registers, search, increments."""
