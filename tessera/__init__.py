"""Tessera: reproducible training-data pipelines and their analytics on PySpark."""
