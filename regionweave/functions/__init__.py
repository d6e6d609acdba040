"""Subpackage of the relational spatial engine."""
