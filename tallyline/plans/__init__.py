"""End-to-end jobs: read, run operators, write."""

from tallyline.plans import scripts, tables, texts

__all__ = ["scripts", "tables", "texts"]
