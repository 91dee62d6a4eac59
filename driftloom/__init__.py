"""Shift-aware feature analytics expressed as Spark DataFrame plans."""
