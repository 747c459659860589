"""Rows apart from their ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of one id apart by their texts (32 bits); a null text is an empty one."""
    return F.hash(doc_id.cast("long"), F.xxhash64(F.coalesce(text, F.lit("")))).cast("long")
