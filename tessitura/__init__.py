"""Transcript-corpus analytics as Spark DataFrame operators."""
