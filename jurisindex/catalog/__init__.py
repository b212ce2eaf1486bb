"""All registered queries and their oracles."""

from jurisindex.catalog import columns, finding, markup_texts, payloads, saving, tables  # noqa: F401
from jurisindex.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
