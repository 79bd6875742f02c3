"""Operators for preparing training corpora; registered queries are in ``queries``."""
