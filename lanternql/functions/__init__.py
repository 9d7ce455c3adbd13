"""Typed values, expressions and predicates."""
