"""JSON shaping and text predicates on the given tables. Replies are built as JSON text and taken apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from muster.functions import ascii_lower, blank_to, date_label, has_value, nth_field, squeeze, strip_all_space
from muster.operators import (
    explode_paths,
    explode_records,
    first_element,
    first_path,
    first_record,
    match_any,
    passthrough,
    project_fields,
    project_paths,
    schema_of_replies,
)
from muster.session import scratch_path
from muster.sources import read_api_snapshots


def reply(endpoint: str, data: Column) -> tuple[Column, Column]:
    return F.lit(endpoint).alias("endpoint"), F.to_json(F.struct(data.alias("data"))).alias("payload")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    replies = t("events").select("event_id", F.lit("event").alias("endpoint"), F.col("props").alias("payload"))
    return project_fields(replies, "event", ["k"], ["event_id"], schema="k BIGINT")


@query("SELECT p_partkey, p_name AS name, p_brand AS version, p_type AS state FROM part")
def self_info(t: Tables) -> DataFrame:
    data = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.col("p_type").alias("state"), "p_size")
    replies = t("part").select("p_partkey", *reply("addons/self/info", data))
    return project_fields(replies, "addons/self/info", ["data.name", "data.version", "data.state"], ["p_partkey"])


@query("SELECT o_orderkey, o_orderpriority AS version, o_orderstatus AS machine, NULL::VARCHAR AS operating_system FROM orders")
def host_info(t: Tables) -> DataFrame:
    data = F.struct(F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("machine"))
    replies = t("orders").select("o_orderkey", *reply("core/info", data))
    fields = ["data.version", "data.machine", "data.operating_system"]
    return project_fields(replies, "core/info", fields, ["o_orderkey"])


def addon_replies(t: Tables) -> DataFrame:
    record = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(line.alias("name"), F.col("lang").alias("slug"), F.col("source").alias("version")),
    )
    return t("documents").select("doc_id", *reply("addons", F.struct(record.alias("addons"))))


@query("""
    SELECT doc_id, unnest(string_split(text, chr(10))) AS name, lang AS slug, source AS version, NULL::VARCHAR AS state FROM documents
""")
def addon_records(t: Tables) -> DataFrame:
    """One record per line of the whole text."""
    replies = addon_replies(t)
    return explode_records(replies, "addons", "data.addons", ["name", "slug", "version", "state"], ["doc_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(t: Tables) -> DataFrame:
    """The same without a schema."""
    replies = t("events").select("event_id", F.lit("event").alias("endpoint"), F.col("props").alias("payload"))
    return project_paths(replies, "event", {"k": ("k", "bigint")}, ["event_id"])


@query("""
    SELECT doc_id, unnest(string_split(text, chr(10))) AS name, lang AS slug, source AS version, NULL::VARCHAR AS state FROM documents
""")
def addon_paths(t: Tables) -> DataFrame:
    """The records of `addon_records` without a schema."""
    fields = {name: (name, "string") for name in ("name", "slug", "version", "state")}
    return explode_paths(addon_replies(t), "addons", "data.addons", fields, ["doc_id"])


@query("SELECT doc_id, string_split(text, chr(10))[1] AS name, source AS version FROM documents")
def first_addon_path(t: Tables) -> DataFrame:
    fields = {"name": ("name", "string"), "version": ("version", "string")}
    return first_path(addon_replies(t), "addons", "data.addons", fields, ["doc_id"])


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS customer, o_orderstatus AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority FROM orders
""")
def found_schema(t: Tables) -> DataFrame:
    """Replies whose keys differ, read with the schema that fits them all."""
    customer = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("customer")
    priority = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority")
    data = F.struct(customer, F.col("o_orderstatus").alias("status"), priority)
    replies = t("orders").select("o_orderkey", *reply("orders", data))
    fields = ["data.customer", "data.status", "data.priority"]
    return project_fields(replies, "orders", fields, ["o_orderkey"], schema=schema_of_replies(replies, "orders"))


@query("SELECT doc_id, source AS interface, to_json(string_split(text, chr(10))[1])::VARCHAR AS ip_address FROM documents")
def network_first(t: Tables) -> DataFrame:
    record = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(F.col("source").alias("interface"), F.struct(line.alias("address")).alias("ipv4")),
    )
    replies = t("documents").select("doc_id", *reply("network/info", F.struct(record.alias("interfaces"))))
    fields = {"interface": "interface", "ip_address": "ipv4.address"}
    first = first_record(replies, "network/info", "data.interfaces", fields, ["doc_id"])
    return first.withColumn("ip_address", F.to_json("ip_address"))


@query("SELECT vec_id, embedding[1] AS first_value FROM embeddings")
def first_array_element(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", first_element(F.col("embedding")).alias("first_value"))


@query("SELECT event_id, props AS payload, json(props)::VARCHAR AS document FROM events")
def reply_passthrough(t: Tables) -> DataFrame:
    replies = t("events").select("event_id", F.col("props").alias("payload"))
    return passthrough(replies).withColumn("document", F.to_json("document"))


@query("""
    SELECT c_custkey, coalesce(segment <> '' AND segment <> 'null', false) AS is_set FROM (
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN 'null' WHEN 'FURNITURE' THEN NULL
            ELSE c_mktsegment END AS segment FROM customer)
""")
def value_is_set(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    text = F.when(segment == "BUILDING", "").when(segment == "MACHINERY", "null").when(segment != "FURNITURE", segment)
    return t("customer").select("c_custkey", has_value(text).alias("is_set"))


@query("""
    SELECT page_id, url FROM pages WHERE (html ILIKE '%<table%' OR html ILIKE '%<script%') AND NOT url ILIKE '%.html'
""")
def substring_filter(t: Tables) -> DataFrame:
    found = match_any(t("pages"), "html", ["*<table*", "*<script*"], ignore_case=True)
    kept = match_any(found, "url", ["*"], ["*.html"], ignore_case=True)
    return kept.select("page_id", "url")


@query("SELECT doc_id FROM documents WHERE (text LIKE '%the%' OR text LIKE 'E_%') AND NOT (text LIKE '%100!%%' ESCAPE '!')")
def text_globs(t: Tables) -> DataFrame:
    return match_any(t("documents"), "text", ["*the*", "E?*"], ["*100%*"]).select("doc_id")


@query("SELECT event_id, strftime(ts, '%a %m-%d %H:%M') AS label FROM events")
def date_labels(t: Tables) -> DataFrame:
    return t("events").select("event_id", date_label(F.col("ts")).alias("label"))


@query(r"""
    SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lowered,
        md5(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS bare,
        md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS squeezed,
        regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+')[2] AS second,
        CASE WHEN lang = 'en' THEN 'default' ELSE lang END AS filled FROM documents
""")
def text_scalars(t: Tables) -> DataFrame:
    text = F.col("text")
    return t("documents").select(
        "doc_id",
        F.md5(ascii_lower(text)).alias("lowered"),
        F.md5(strip_all_space(text)).alias("bare"),
        F.md5(squeeze(text)).alias("squeezed"),
        nth_field(text, 2).alias("second"),
        blank_to(F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), F.lit("default")).alias("filled"),
    )


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS installation_id, o_orderdate AS observed_at, o_orderpriority AS version, o_orderstatus AS machine
    FROM orders WHERE o_orderstatus <> 'F'
""")
def landed_replies(t: Tables) -> DataFrame:
    """Replies of two endpoints landed as JSON lines; only one endpoint is parsed."""
    path = scratch_path(t.spark, "replies")
    data = F.struct(F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("machine"))
    t("orders").select(
        F.col("o_custkey").cast("string").alias("installation_id"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.when(F.col("o_orderstatus") == "F", "addons").otherwise("core/info").alias("endpoint"),
        F.to_json(F.struct(data.alias("data"))).alias("payload"),
    ).write.json(path)
    replies = read_api_snapshots(t.spark, path, "core/info")
    found = project_fields(replies, "core/info", ["data.version", "data.machine"])
    return found.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
