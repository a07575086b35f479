"""Readers, reshaping and writers of the tables that the jobs start from and end in."""
