"""Registered queries by family, and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["profile", "prepare", "metrics", "catalog", "sql", "models", "streams", "proofs", "neighbours", "fits"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"tabloom.queries.{family}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
