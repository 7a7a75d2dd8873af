"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ["describe", "preparing", "meta", "grouping", "learning", "assembly"]


def load():
    """Import every query module and return the registry they filled."""
    for name in MODULES:
        importlib.import_module(f"tabloom.catalog.{name}")
    return importlib.import_module("tabloom.catalog.registry")
