"""Reusable analytic query shapes and report jobs on Spark DataFrames."""
