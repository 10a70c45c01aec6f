"""Sessions, peers and messages: what comes in. Functions take tables and return new tables or rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix.functions import text as T
from engramix.functions.ranking import numbered
from engramix.vocabulary import ROLES


def at(as_of: str) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}'")


def open_sessions(sessions: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Rows to append: ids (session_id) that have no session yet, once each."""
    new = ids.select("session_id").filter("session_id is not null").distinct().join(sessions.select("session_id"), "session_id", "left_anti")
    none = F.lit(None)
    return new.select("session_id", at(as_of).alias("started_at"), none.cast("timestamp_ntz").alias("ended_at"), none.cast("string").alias("summary"))


def close_sessions(sessions: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """All sessions; those of ids get an end unless they have one."""
    hit = ids.select("session_id").distinct().withColumn("_hit", F.lit(True))
    return sessions.join(hit, "session_id", "left").withColumn("ended_at", F.coalesce("ended_at", F.when(F.col("_hit"), at(as_of)))).drop("_hit")


def append_messages(messages: DataFrame, turns: DataFrame, as_of: str) -> DataFrame:
    """Rows to append for turns (session_id, pos, role, content, optionally peer_id), numbered on from the last id.

    An unknown role or a null content fails the whole batch.
    """
    bad = F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("null")))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(bad))
    content = F.when(F.col("content").isNotNull(), F.col("content")).otherwise(F.raise_error(F.lit("a message needs a content")))
    rows = turns.select("session_id", "pos", role.alias("role"), content.alias("content"), (F.col("peer_id") if "peer_id" in turns.columns else F.lit(None).cast("string")).alias("peer_id"))
    last = messages.agg(F.max("id")).first()[0] or 0
    return numbered(rows, "id", "session_id", "pos", start=last + 1).drop("pos").withColumn("created_at", at(as_of))


def captured_turns(payloads: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Turns of JSON conversations (session_id and a JSON array of {role, content}), and the payloads that are none.

    Turns with an unknown role, or a content that is blank or no string, are dropped.
    """
    parsed = payloads.withColumn("_v", F.try_parse_json(F.col(raw))).withColumn("_kind", F.schema_of_variant("_v"))
    is_array = F.coalesce(F.col("_kind").startswith("ARRAY"), F.lit(False))
    errors = parsed.filter(~is_array).select("session_id", F.when(F.col("_v").isNull(), "invalid JSON").otherwise("not a JSON array").alias("error"))
    items = parsed.filter(is_array).select("session_id", F.posexplode(F.expr("try_variant_get(_v, '$', 'array<variant>')")).alias("pos", "item")).filter(F.schema_of_variant("item").startswith("OBJECT"))
    member = lambda p: F.when(F.schema_of_variant(F.expr(f"try_variant_get(item, '$.{p}', 'variant')")) == "STRING", F.try_variant_get("item", f"$.{p}", "string"))
    turns = items.select("session_id", "pos", member("role").alias("role"), member("content").alias("content"))
    return turns.filter(F.col("role").isin(*ROLES) & (F.trim("content") != "")), errors


def uploaded_turns(spark: SparkSession, path: str, session: str, role: str = "user") -> DataFrame:
    """Every file of a path as one turn; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.lit(session).alias("session_id"), F.lit(role).alias("role"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return numbered(rows, "pos", "path").select("session_id", "pos", "role", "content")


def register_peers(peers: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """All peers with new ones (pos, workspace_id, id, role, metadata) put in; the last of an id wins, missing roles are inferred."""
    key = ["workspace_id", "id"]
    last = new.groupBy(*key).agg(F.max_by(F.struct("role", "metadata"), "pos").alias("r"))
    put = last.select(*key, F.coalesce("r.role", T.infer_role(F.col("id"))).alias("role"), F.coalesce("r.metadata", F.lit("{}")).alias("metadata"), at(as_of).alias("registered_at"))
    return peers.join(put, key, "left_anti").unionByName(put)


def parsed_peers(bodies: DataFrame, raw: str = "raw") -> DataFrame:
    """Peers of request bodies: an object of id to settings, an array of ids or objects with id, or such an array under `peers`."""
    v = bodies.withColumn("_v", F.try_parse_json(F.col(raw)))
    inner = F.expr("try_variant_get(_v, '$.peers', 'variant')")
    v = v.withColumn("_v", F.when(F.schema_of_variant(inner).startswith("ARRAY"), inner).otherwise(F.col("_v")))
    by_id = v.filter(F.schema_of_variant("_v").startswith("OBJECT")).select("workspace_id", F.posexplode(F.map_entries(F.expr("try_variant_get(_v, '$', 'map<string,variant>')"))).alias("pos", "e"))
    listed = v.filter(F.schema_of_variant("_v").startswith("ARRAY")).select("workspace_id", F.posexplode(F.expr("try_variant_get(_v, '$', 'array<variant>')")).alias("pos", "e"))
    a = by_id.select("workspace_id", "pos", F.col("e.key").alias("id"), F.try_variant_get("e.value", "$.role", "string").alias("role"), F.to_json("e.value").alias("metadata"))
    plain = F.schema_of_variant("e") == "STRING"
    b = listed.select("workspace_id", "pos", F.when(plain, F.try_variant_get("e", "$", "string")).otherwise(F.try_variant_get("e", "$.id", "string")).alias("id"), F.when(~plain, F.try_variant_get("e", "$.role", "string")).alias("role"), F.when(plain, "{}").otherwise(F.coalesce(F.to_json(F.expr("try_variant_get(e, '$.metadata', 'variant')")), F.to_json("e"))).alias("metadata"))
    return a.unionByName(b).filter("id is not null and id <> ''")


def peer_config(peers: DataFrame) -> DataFrame:
    """What each peer lets others observe; true unless its metadata says false."""
    flag = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}").cast("boolean"), F.lit(True)).alias(k)
    return peers.select("workspace_id", "id", flag("observe_me"), flag("observe_others"))


def resolved_roles(turns: DataFrame, peers: DataFrame, workspace: str) -> DataFrame:
    """turns (peer_id) with role: the registered one, else inferred from the peer's id."""
    known = peers.filter(F.col("workspace_id") == workspace).select(F.col("id").alias("peer_id"), F.col("role").alias("_role"))
    return turns.drop("role").join(known, "peer_id", "left").withColumn("role", F.coalesce("_role", T.infer_role(F.col("peer_id")))).drop("_role")


def mention_index(chunks: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk_id and entity: names in the chunk's text that are an alias, a subject or an object of the graph."""
    named = chunks.select("chunk_id", F.explode(T.entity_candidates(F.col("text"), unicode=False)).alias("c"))
    known = aliases.select(F.col("alias").alias("c"), F.col("canonical").alias("entity")).unionByName(edges.select(F.explode(F.array("s", "o")).alias("c")).distinct().withColumn("entity", F.col("c"))).distinct()
    return named.join(known, "c").select("chunk_id", "entity").distinct()


def resolve(names: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """Adds `out`: the canonical of a surface name, by alias, else its normal form."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    norm = names.withColumn("_norm", T.normalize(F.col(column)))
    return norm.join(a, norm["_norm"] == a["_alias"], "left").withColumn(out, F.coalesce("_canonical", "_norm")).drop("_norm", "_alias", "_canonical")
