"""Operators on texts for training data; nothing else in the library imports this package."""

#: Modules with QUERIES and ORACLE, in the order of registration.
MODULES: list[str] = ["p8", "p9", "p10"]
