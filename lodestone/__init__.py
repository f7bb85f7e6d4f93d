"""Lodestone: batch retrieval, grounding and retrieval evaluation on PySpark."""
