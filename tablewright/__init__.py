"""Spark-native data readiness: profile, score, clean, impute, predict and prepare tables."""
