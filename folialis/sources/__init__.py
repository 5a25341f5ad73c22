"""Readers: tables, snapshots, model lists, feeds, PDF files."""
