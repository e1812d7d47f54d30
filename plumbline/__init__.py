"""Plumbline: drawings as relational data on Spark DataFrames."""
