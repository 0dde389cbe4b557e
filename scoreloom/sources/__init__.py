"""Readers and writers, and the extraction of answers from free text."""
