"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_map(table: dict[str, str]) -> Column:
    """A constant map.  It is one literal, which Catalyst reads once while planning."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value made once per row.

    A value named by an earlier column is copied into every place that uses it when Catalyst merges
    projections or pushes a filter down; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
