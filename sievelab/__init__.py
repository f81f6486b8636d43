"""Noisy-label analytics on Spark: clean, split, corrupt, vectorise, detect, retrain, score."""
