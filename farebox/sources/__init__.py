"""Readers, structural checks and the mapping from source columns to the fixed trip schema."""
