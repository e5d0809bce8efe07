"""Operators for preparing large text and embedding corpora. Nothing outside this subpackage imports it."""
