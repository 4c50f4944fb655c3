"""Readers and writers at the table and file edge."""
