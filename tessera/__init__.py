"""Tessera: entity resolution, ownership analytics and data preparation as Spark plans."""
