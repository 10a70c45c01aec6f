"""Validation of model answers (JSON) and embedding of texts that lack a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramix.vocabulary import ENTITY_TYPES, MARKER_PROFILE, PREDICATES


def items(answers: DataFrame, raw: str) -> DataFrame:
    """One row per object of each answer that is a JSON array; `n` is its place."""
    parsed = answers.withColumn("_v", F.try_parse_json(F.col(raw)))
    arrays = parsed.filter(F.schema_of_variant("_v").startswith("ARRAY"))
    each = arrays.select("*", F.posexplode(F.expr("try_variant_get(_v, '$', 'array<variant>')")).alias("n", "item")).drop("_v")
    return each.filter(F.schema_of_variant("item").startswith("OBJECT"))


def string_member(path: str) -> Column:
    """A string member, trimmed; null if it is missing, blank or no string."""
    kind = F.schema_of_variant(F.expr(f"try_variant_get(item, '$.{path}', 'variant')"))
    value = F.trim(F.try_variant_get("item", f"$.{path}", "string"))
    return F.when((kind == "STRING") & (value != ""), value)


def validate_triples(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Valid triples: strings, a known predicate, polarity 1 or -1 (1 if missing)."""
    kind = F.coalesce(F.schema_of_variant(F.expr("try_variant_get(item, '$.polarity', 'variant')")), F.lit("VOID"))
    value = F.try_variant_get("item", "$.polarity", "double")
    missing = F.try_variant_get("item", "$.polarity", "variant").isNull()
    polarity = F.when(missing, 1).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.when(value == 1, 1).when(value == -1, -1))
    numeric = F.when(F.schema_of_variant(F.expr("try_variant_get(item, '$.value_numeric', 'variant')")).rlike("BIGINT|DOUBLE|DECIMAL"), F.try_variant_get("item", "$.value_numeric", "double"))
    out = items(answers, raw).select(
        *[c for c in answers.columns if c != raw], "n", string_member("subject").alias("subject"), string_member("predicate").alias("predicate"), string_member("object").alias("object"), polarity.alias("polarity"),
        string_member("value_text").alias("value_text"), numeric.alias("value_numeric"), string_member("value_unit").alias("value_unit"), string_member("temporal_scope").alias("temporal_scope"),
    )
    return out.filter(F.col("subject").isNotNull() & F.col("object").isNotNull() & F.col("predicate").isin(*PREDICATES) & F.col("polarity").isNotNull())


def entity_type_hints(answers: DataFrame, raw: str = "raw", key: str = "chunk_id") -> DataFrame:
    """Last valid type of each surface in an answer."""
    each_item = items(answers, raw)
    pair = lambda who: F.struct(string_member(who).alias("surface"), string_member(f"{who}_type").alias("type"))
    each = each_item.select(key, "n", F.explode(F.array(pair("subject"), pair("object"))).alias("h")).select(key, "n", "h.*").filter(F.col("surface").isNotNull() & F.col("type").isin(*ENTITY_TYPES))
    return each.groupBy(key, "surface").agg(F.max_by("type", "n").alias("type"))


def validate_markers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    out = items(answers, raw).select(*[c for c in answers.columns if c != raw], "n", string_member("kind").alias("kind"), string_member("statement").alias("statement"))
    return out.filter(F.col("kind").isin(*MARKER_PROFILE) & F.col("statement").isNotNull())


def procedure_steps(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Procedures with their valid steps in order, numbered anew; those without steps or name are dropped."""
    found = items(answers, raw).select(*[c for c in answers.columns if c != raw], "n", string_member("name").alias("name"), F.substring(F.coalesce(string_member("description"), F.lit("")), 1, 500).alias("description"), F.expr("try_variant_get(item, '$.steps', 'array<struct<`order`:double,action:string,tool:string>>')").alias("steps"), *[F.coalesce(F.expr(f"try_variant_get(item, '$.{p}', 'array<string>')"), F.array().cast("array<string>")).alias(c) for p, c in (("triggers", "triggers"), ("entities_involved", "entities"))])
    good = F.filter("steps", lambda s: s["order"].isNotNull() & (F.trim(F.coalesce(s["action"], F.lit(""))) != ""))
    placed = F.array_sort(F.transform(good, lambda s, i: F.struct(s["order"].alias("o"), i.alias("i"), F.trim(s["action"]).alias("action"), s["tool"].alias("tool"))))
    return found.withColumn("steps", F.transform(placed, lambda s, i: F.struct((i + 1).alias("order"), s["action"].alias("action"), s["tool"].alias("tool")))).filter(F.col("name").isNotNull() & (F.size("steps") > 0))


def pending_embeddings(texts: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    """Rows of texts without a vector of this model."""
    return texts.join(vectors.filter(F.col("model") == model).select(key), key, "left_anti")


def stub_embedding(text: Column, dim: int = 16) -> Column:
    """Deterministic unit vector from the text's SHA-256: bytes / 255 - 0.5, normalised."""
    # each step is bound to a name of its own, as a lambda's argument: else every element would hash and norm anew
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    bytes_of = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5)
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda raw: bound(norm(raw), lambda n: F.transform(raw, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))
    return bound(F.sha2(text.cast("binary"), 256), lambda h: bound(bytes_of(h), scaled))
