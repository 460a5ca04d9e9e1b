"""Subsurface grid analytics on Spark: keyed DataFrames for cells, faces, wells and surfaces."""
