"""Readers and writers of chat files."""
