"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator module has
a general interface and, where a registered query exists, a thin ``op_query``.
"""
