"""Operators for preparing language-model training corpora.

The subpackage stands alone: nothing else in the library imports it.  Each module
holds one operator with a general interface; ``queries`` wraps them for the
registered tables.
"""
