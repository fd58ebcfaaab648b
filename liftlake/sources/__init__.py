"""Readers, the dataset catalog and the run history table."""
