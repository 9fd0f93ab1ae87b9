"""Readers: files and tables to records and features."""
