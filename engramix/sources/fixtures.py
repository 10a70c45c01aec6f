"""The driver's tables seen as memory tables: messages, evidence, the graph, chunks and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICATE_OF = {"ECONOMY": "uses", "SMALL": "prefers", "STANDARD": "rejects", "MEDIUM": "avoids", "LARGE": "runs_on", "PROMO": "depends_on"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.coalesce("text", F.lit("")).alias("content"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int))").alias("created_at"),
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """s, p, o, chunk_id, polarity, ts: one row per line item."""
    predicate = F.create_map(*[F.lit(x) for kv in PREDICATE_OF.items() for x in kv])
    part = read(spark, d, "part").select("p_partkey", predicate[F.col("p_type")].alias("p"), F.regexp_replace("p_name", " ", "_").alias("o"))
    supplier = read(spark, d, "supplier").select("s_suppkey", F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_")).alias("s"))
    line = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("chunk_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("polarity"), F.col("l_shipdate").alias("ts"))
    return line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).select("s", "p", "o", "chunk_id", "polarity", "ts")


def graph(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(evidence(spark, d))


def edges_of(ev: DataFrame) -> DataFrame:
    return (
        ev.groupBy("s", "p", "o")
        .agg(
            F.count_if(F.col("polarity") == 1).alias("pos"), F.count_if(F.col("polarity") == -1).alias("neg"), F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"), F.max(F.when(F.col("polarity") == 1, F.col("ts"))).alias("last_reinforced"),
        )
        .withColumns({"status": F.lit("active"), "derived": F.lit(False)})
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("created_at"))


def mentions(ev: DataFrame) -> DataFrame:
    return ev.select("chunk_id", F.explode(F.array("s", "o")).alias("entity")).distinct()


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """depends_on edges segment -> nation -> region -> world."""
    n, r, c = read(spark, d, "nation"), read(spark, d, "region"), read(spark, d, "customer")
    zero = F.lit(0).cast("long").alias("neg")
    one = F.lit(1).cast("long").alias("pos")
    a = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("s"), F.col("n_name").alias("o")).agg(F.count(F.lit(1)).alias("pos"), F.lit(0).cast("long").alias("neg"))
    b = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("s"), F.col("r_name").alias("o"), one, zero)
    return a.unionByName(b).unionByName(r.select(F.col("r_name").alias("s"), F.lit("world").alias("o"), one, zero))
