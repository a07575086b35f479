"""Operators for building training corpora from text tables. Nothing outside this folder imports it."""
