"""Readers and writers: contest JSON, archives, live feed pages, tables."""
