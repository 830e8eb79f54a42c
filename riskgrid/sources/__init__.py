"""Readers, writers and the loan-book view of the test tables."""
