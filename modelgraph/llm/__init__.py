"""Operators for preparing language-model training corpora at cluster scale.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered ``opN_<name>`` queries, every other module is one operator.
"""
