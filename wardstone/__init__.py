"""Tenancy, authorization and audit analytics on Spark DataFrames."""
