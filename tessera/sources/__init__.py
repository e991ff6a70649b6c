"""Readers of feeds, alerts, listings and tables, and writers of data sets, by Spark's own formats."""
