"""Moderation of utterances, and upkeep of the moderation classifier, on Spark."""
