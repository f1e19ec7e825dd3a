"""Streaming: intentionally empty.

The reference workbench has no streams, watermarks, windows or stateful
operators (SURVEY §2.17); every operator of this package works on batch
DataFrames.
"""
