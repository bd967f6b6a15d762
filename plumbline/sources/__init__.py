"""Readers of tables, packages and documents."""

from plumbline.sources.tables import load

__all__ = ["load"]
