"""Pipelines: steps that are functions of lazy DataFrames."""
