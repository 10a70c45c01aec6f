"""Ranks over all rows without sorting them in one task: consecutive numbers, the n-th row, the first n."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.sources.checkpoint import cut


def numbered(df: DataFrame, name: str, *order: str, start: int = 1) -> DataFrame:
    """Adds `name`: start, start + 1, ... in the order of the columns.

    Rows are range-partitioned once; the driver sees one count per partition, and each partition is
    numbered by itself from the sum of those before it.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    seen, at = {}, start
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        seen[r["_part"]] = at
        at += r["n"]
    if not seen:
        return df.withColumn(name, F.lit(start).cast("long"))
    before = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])[F.col("_part")]
    w = Window.partitionBy("_part").orderBy(*order)
    return placed.withColumn(name, (before + F.row_number().over(w) - 1).cast("long")).drop("_part")


def nth(df: DataFrame, n: int, *order: str, bins: int = 1024) -> tuple[list, int]:
    """The values that the n-th row of df has in the columns of `order`, and how many of the rows that agree with it are among the first n.

    Distributed selection: no rows are sorted or moved. Numbers and times are counted in `bins` equal
    spans, and the span that holds the n-th row is cut again until it is one value; strings are
    counted by their next character, and so on along the one prefix that holds it. The driver sees
    the counts of one such step at a time. Nulls come first. df has at least n rows.
    """
    found, left, rest = [], n, df
    for c in order:
        kind = df.schema[c].dataType.simpleString()
        nulls = rest.filter(F.col(c).isNull()).count()
        if left <= nulls:
            found.append(None)
            rest = rest.filter(F.col(c).isNull())
            continue
        left -= nulls
        rest = rest.filter(F.col(c).isNotNull())
        if kind == "string":
            prefix, ended = "", False
            while not ended:
                head = F.substring(c, 1, len(prefix) + 1)
                counts = sorted((r["k"], r["n"]) for r in rest.groupBy(head.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
                for k, m in counts:
                    if left <= m:
                        break
                    left -= m
                ended, prefix, rest = k == prefix, k, rest.filter(head == k)
            found.append(prefix)
            continue
        number = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(c).cast("timestamp_ntz")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c)
        rest = rest.withColumn("_n", number.cast("decimal(38,0)"))
        low, high = (int(x) for x in rest.agg(F.min("_n"), F.max("_n")).first())
        while low < high:
            width = -(-(high - low + 1) // bins)
            span = F.expr(f"(_n - {low}BD) div {width}BD")
            counts = {r["b"]: r["n"] for r in rest.groupBy(span.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for b in sorted(counts):
                if left <= counts[b]:
                    break
                left -= counts[b]
            low, high = low + b * width, min(high, low + (b + 1) * width - 1)
            rest = rest.filter(F.col("_n").between(low, high))
        found.append(rest.select(c).first()[0])
        rest = rest.drop("_n")
    return found, left


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n first rows of df by the columns of `order` (ascending, nulls first), all if it has no more; of rows that agree in all of them, any."""
    if n <= 0 or df.count() <= n:
        return df if n > 0 else df.limit(0)
    values, left = nth(df, n, *order)
    lit = lambda c, v: F.lit(v).cast(df.schema[c].dataType)
    before, same = F.lit(False), F.lit(True)
    for c, v in zip(order, values, strict=True):
        before |= same & (F.col(c).isNull() & F.lit(v is not None) | F.coalesce(F.col(c) < lit(c, v), F.lit(False)))
        same &= F.col(c).eqNullSafe(lit(c, v))
    return df.filter(before).unionByName(df.filter(same).limit(left))
