"""Continuous forms of the batch operators, for images and reports that keep arriving."""
