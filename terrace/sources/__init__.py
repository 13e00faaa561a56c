"""Readers and writers of layers and reports."""
