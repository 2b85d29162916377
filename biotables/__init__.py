"""Genome-bin and transcript-count analytics as plain functions on Spark DataFrames."""
