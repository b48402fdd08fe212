"""Readers and writers: bars, models, run reports."""
