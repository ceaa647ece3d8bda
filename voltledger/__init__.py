"""Checks, routes and learns from utility bills with Spark DataFrames."""
