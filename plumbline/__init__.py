"""Plumbline: analytics operators as Spark plans, DataFrame in and DataFrame out."""
