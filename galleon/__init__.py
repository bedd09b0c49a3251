"""Galleon: a PySpark-native analytics engine for media-library style tables.

Every capability is a plain function from DataFrames to DataFrames; Catalyst
picks the physical plan.  Subpackages: ``functions`` (column expressions),
``operators`` (relational, vector and graph operators), ``sources`` (readers and
writers), ``plans`` (query builders) and ``streaming`` (incremental operators).
"""
