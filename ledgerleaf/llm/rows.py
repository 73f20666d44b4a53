"""Row identity, and names that no column of a table has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity() -> tuple[Column, Column]:
    """Two independent 64-bit hashes of (doc_id, text).

    Rows that agree in both hold the same doc_id and text, so whatever depends on these
    alone is the same for them; that holds with every doc_id null or equal, too.
    """
    return F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), F.col("text")), F.xxhash64(F.lit(2), F.col("text"), F.col("doc_id").cast("long"))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """For each of ``names`` the first of name, name_2, name_3, ... that ``columns`` doesn't have, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        made, n = name, 1
        while made.lower() in taken:
            n += 1
            made = f"{name}_{n}"
        taken.add(made.lower())
        out.append(made)
    return out
