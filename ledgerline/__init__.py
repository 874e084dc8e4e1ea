"""Execution logs, document memory and corpus preparation on Spark DataFrames."""
