"""A join that a hot key cannot slow down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more rows than this part of an even partition; so at most PARTS * partitions keys are heavy.
PARTS = 4
#: A key of up to so many rows is never heavy.
FEW_ROWS = 1000


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], counts: DataFrame | None = None,
                total: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per key; any key may hold any share of ``rows``.

    Keys are counted first, combined before the shuffle.  Rows of heavy keys meet their (few) table
    rows by broadcast and are never shuffled; a key of the rest is too small to fill a task.  The
    broadcast holds at most ``PARTS`` times the number of shuffle partitions rows whatever the data.
    ``counts`` has the rows per key in ``n`` and ``total`` their number, if the caller knows them already.
    Rows with a null key match nothing and stay where they are.
    """
    on = list(on)
    total = rows.count() if total is None else total
    if total <= FEW_ROWS:
        return rows.join(table, on, "left").select(*rows.columns, *[c for c in table.columns if c not in on])
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    least = max(FEW_ROWS, total / (PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    known = F.lit(True)
    for c in on:
        known &= F.col(c).isNotNull()
    heavy = counts.where(known & (F.col("n") > least)).select(*on)
    extra = [c for c in table.columns if c not in on]
    few = table.join(F.broadcast(heavy), on, "left_semi")
    named = F.broadcast(heavy.join(few, on, "left").withColumn("__hot", F.lit(True)))
    tagged = rows.join(named, on, "left")
    out = [*rows.columns, *extra]
    fixed = tagged.where(F.col("__hot").isNotNull() | ~known).select(*out)
    rest = tagged.where(F.col("__hot").isNull() & known).select(*rows.columns).join(table, on, "left").select(*out)
    return fixed.unionByName(rest)
