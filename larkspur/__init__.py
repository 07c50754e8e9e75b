"""Larkspur: a small relational engine and corpus toolkit built natively on PySpark."""
