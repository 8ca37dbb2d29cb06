"""Registered queries and their SQL, by module."""

from __future__ import annotations

import importlib

#: Modules in the order of registration.
MODULES = ["p1", "p2", "p3", "p4", "p5", "p6", "p7", "reference"]


def collect(package: str, modules: list[str]) -> tuple[dict, dict]:
    found, sql = {}, {}
    for m in modules:
        mod = importlib.import_module(f"{package}.{m}")
        found |= mod.QUERIES
        sql |= mod.ORACLE
    return found, sql
