"""Readers and writers: statement tables, artifacts, predictions."""
