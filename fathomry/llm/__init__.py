"""Corpus operators for training-data pipelines.

Each module holds one operator with its general interface and a thin
``query(spark, sf_dir)`` that applies it to a whole table.
"""
