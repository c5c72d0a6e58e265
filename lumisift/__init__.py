"""Ranked search over names and paths, usage analytics and change tracking as PySpark DataFrame plans."""
