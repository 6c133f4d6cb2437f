"""Clausemill: contract and document analytics as Spark DataFrame operators."""
