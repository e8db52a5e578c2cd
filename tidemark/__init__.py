"""Bitemporal, Datalog-style analytics compiled to Spark DataFrames."""
