"""Registered queries by subject; each module has QUERIES and ORACLE_SQL."""
