"""Relational, evaluation, grouping and sampling operators."""
