"""Readers, writers and record normalisation."""
