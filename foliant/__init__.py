"""Foliant: records and document analytics on the Spark DataFrame API."""
