"""Pipelines made of operators, and the commands over stored runs."""
