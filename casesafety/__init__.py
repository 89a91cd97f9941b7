"""Batch jobs over evaluation cases, reviewed predictions and responses, as Spark DataFrame transformations."""
