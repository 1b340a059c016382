"""Operators for large training corpora. Nothing else in plumbline imports this subpackage."""
