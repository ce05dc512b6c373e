"""Readers and writers: retail tables, intake files, result sinks."""
