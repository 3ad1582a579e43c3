"""Scalar and table functions: text as columns, table grids, block parsing and chunking."""
