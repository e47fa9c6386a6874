"""Structural code intelligence as Spark plans."""
