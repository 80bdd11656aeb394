"""Readers: match documents, registers, embedded page data, tables and the test adapter."""
