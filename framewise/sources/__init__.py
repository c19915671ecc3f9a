"""Readers and writers: tables with fixed schemas, motion-parameter files, listings and NIfTI volumes."""
