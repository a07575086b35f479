"""Batch jobs for regional crop-yield data, written as Spark DataFrame operators."""
