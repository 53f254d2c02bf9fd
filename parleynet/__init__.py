"""Relation-network analytics as Spark DataFrames."""
