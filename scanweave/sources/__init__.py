"""Readers and writers: SPEC text, array files, scan packages, result cache."""
