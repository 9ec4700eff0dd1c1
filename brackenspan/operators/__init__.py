"""Operators over documents as DataFrames."""
