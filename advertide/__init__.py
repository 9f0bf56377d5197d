"""Spark jobs for indicator series and advertisement corpora."""
