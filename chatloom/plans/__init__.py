"""Queries over the driver tables: bindings, query registry, reference SQL."""
