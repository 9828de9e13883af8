"""Declarative pipelines and ready-made plans."""
