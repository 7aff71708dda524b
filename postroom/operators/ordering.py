"""Null placement as row stores have it: ascending puts nulls last, descending first.

``collation``: the order of texts, one of Spark's collations such as ``UNICODE``
(letters before accents before case) or ``UNICODE_CI``; without one texts are ordered by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collated(name: str, collation: str | None) -> Column:
    return F.col(name) if collation is None else F.collate(F.col(name), collation)


def asc(name: str, collation: str | None = None) -> Column:
    return collated(name, collation).asc_nulls_last()


def desc(name: str, collation: str | None = None) -> Column:
    return collated(name, collation).desc_nulls_first()
