"""Lookup joins whose small side is broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.session import materialize_sized

# Largest lookup table (bytes of its values as text) that is broadcast, and
# the bytes that a row of unknown width counts for.
BROADCAST_BYTE_LIMIT = 64 << 20
ROW_BYTES = 64


def checked_small(small: DataFrame, max_bytes: int = BROADCAST_BYTE_LIMIT,
                  bound: int | None = None) -> tuple[DataFrame, bool]:
    """Say whether ``small`` may be broadcast.

    ``bound`` is a row bound known by construction (a fixed list, a
    one-row aggregate, the size of a fitted vocabulary); otherwise the table
    is materialized in the shared folder and its bytes are observed during
    that write.
    """
    if bound is not None:
        return small, bound * ROW_BYTES <= max_bytes
    if small.isStreaming:
        return small, False
    small, _, size = materialize_sized(small, "lookup")
    return small, size <= max_bytes


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                max_bytes: int = BROADCAST_BYTE_LIMIT, bound: int | None = None
                ) -> DataFrame:
    """Join ``big`` to a lookup table.

    Broadcast when the lookup holds at most ``max_bytes``; otherwise a
    shuffle join that AQE may split for skewed keys.
    """
    small, ok = checked_small(small, max_bytes, bound)
    return big.join(F.broadcast(small) if ok else small, on, how)


def cross_one_row(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row table (bounds, stats) to every row.

    The right side is a global aggregate, so its size is one row by
    construction; the broadcast keeps the big side unshuffled.
    """
    return big.crossJoin(F.broadcast(one_row))
