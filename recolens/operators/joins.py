"""Join helpers that keep broadcasts behind a size check and split hot keys.

``maybe_broadcast`` counts the rows and bytes of the small side and hints a
broadcast only within both bounds; otherwise the plan is left to the optimizer
(sort-merge join with AQE skew splitting, or AQE's own runtime broadcast
conversion, which is itself size-checked against real shuffle sizes).
``salted_join`` is the explicit fallback for a big side whose join key may hold
a large share of the rows: the big side gets a salt in ``[0, buckets)`` and the
small side is replicated once per salt, so a hot key is spread over
``buckets`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 2_000_000


MAX_BROADCAST_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: strings and binaries by length, arrays and maps by their
    elements, anything else 8."""
    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(c) + 16
        if kind.startswith(("array<string", "map<")):
            return F.octet_length(F.to_json(F.struct(c)))
        return F.size(c) * 8 + 16 if kind.startswith("array") else F.lit(8)
    return sum((F.coalesce(of(n, k), F.lit(0)).cast("long") for n, k in df.dtypes), F.lit(16).cast("long"))


def fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes, summed in parallel."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return size.n <= max_rows and (size.b or 0) <= max_bytes


def checked_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS):
    """Materialise ``df`` once (reliable checkpoint) and test its size on the
    materialised copy, so the size check never recomputes the upstream plan.
    Returns ``(frame, is_small)``; a small frame comes back broadcast-hinted."""
    from recolens.session import cut_lineage
    frozen = cut_lineage(df)
    small = fits(frozen, max_rows)
    return (F.broadcast(frozen) if small else frozen), small


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the frame is proven to be within the bounds."""
    return F.broadcast(df) if fits(df, max_rows) else df


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                buckets: int = 32, salt_expr: Column | None = None) -> DataFrame:
    """Equi-join that spreads every key of ``big`` over ``buckets`` salts.

    ``small`` is exploded once per salt (its size grows by ``buckets``), so use
    this only when ``small`` is the side with at most one row per key.
    """
    salt = salt_expr if salt_expr is not None else F.pmod(
        F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(buckets))
    b = big.withColumn("__salt", salt.cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, on + ["__salt"], how).drop("__salt")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = DEFAULT_BROADCAST_ROWS, buckets: int = 32) -> DataFrame:
    """Broadcast ``small`` if its size is checked below ``max_rows``; else salt."""
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, buckets)
