"""Readers and writers for order tables, order streams and result tables."""
