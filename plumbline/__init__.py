"""plumbline: data trust on Spark - comparison, quality, metrics, telemetry, lineage and text operators.

Every operator takes DataFrames and returns DataFrames; nothing here starts a
session of its own or keeps state outside of the tables it is given.
"""
