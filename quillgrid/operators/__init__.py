"""Operators on whole arrays beside the language: the blocked encoding and algorithms."""
