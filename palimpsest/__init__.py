"""Conversational-memory analytics on Spark: facts, entities, recall and life cycle for many owners at once."""
