"""Readers and writers: key files, benchmark logs, memory reports, CSV."""
