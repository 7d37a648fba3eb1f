"""Host readings and check results on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from muster.functions import kb_to_mb
from muster.operators import any_true, attach_severity, classify_environment, error_count, threshold_flags, verdict
from muster.plans.flows import health_report, resource_flags
from muster.session import scratch_path
from muster.sources import parse_df, parse_log_lines, parse_meminfo, read_log_lines
from muster.streaming import run_to_table

# Fixed values of this binding: a rule per event type.
RULES = [
    ("error", "stability", "error", True),
    ("view", "stability", "warning", True),
    ("click", "usage", "error", True),
    ("signup", "usage", "warning", False),
]
RULES_SQL = """(VALUES ('error', 'stability', 'error', true), ('view', 'stability', 'warning', true),
    ('click', 'usage', 'error', true), ('signup', 'usage', 'warning', false)) AS r(probe, check_name, severity, counts)"""
LIMITS = [("click", 20.0, "warning"), ("error", 50.0, "error"), ("view", 10.5, "error")]


@query("SELECT doc_id, CAST(trunc(n_chars / 1024) AS BIGINT) AS mb FROM documents")
def int_trunc(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", kb_to_mb(F.col("n_chars")).alias("mb"))


def memory_lines(t: Tables) -> DataFrame:
    lines = F.array(
        F.concat(F.lit("MemTotal:       "), F.col("l_orderkey") + 300_000, F.lit(" kB")),
        F.lit("Buffers:            1000 kB"),
        F.concat(F.lit("MemAvailable:   "), (F.col("l_quantity") * 10_000).cast("bigint"), F.lit(" kB")),
    )
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(lines).alias("pos", "line"))


LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, max((l_orderkey + 300000) // 1024) AS memory_total,
        max(CAST(l_quantity * 10000 AS BIGINT) // 1024) AS memory_available
    FROM lineitem GROUP BY ALL
""")
def memory_readings(t: Tables) -> DataFrame:
    return parse_meminfo(memory_lines(t), LINE)


def disk_lines(t: Tables) -> DataFrame:
    lines = F.array(
        F.lit("Filesystem  1M-blocks  Used Available Use% Mounted on"),
        F.concat(F.lit("/dev/sda1      30000 20000  "), F.col("p_size") * 7, F.lit("  67% /data")),
    )
    return t("part").select("p_partkey", F.posexplode(lines).alias("pos", "line"))


@query("SELECT p_partkey, p_size * 7 AS disk_free FROM part")
def disk_readings(t: Tables) -> DataFrame:
    free = parse_df(disk_lines(t), ["p_partkey"])
    return free.withColumn("disk_free", F.col("disk_free").cast("int"))


@query("""
    SELECT p_partkey, 'memory_available' AS metric, p_partkey * 500 // 1024 AS value,
        CASE WHEN p_partkey * 500 // 1024 < 256 THEN 'error' ELSE 'info' END AS severity FROM part
    UNION ALL
    SELECT p_partkey, 'disk_free', p_size * 7, CASE WHEN p_size * 7 < 100 THEN 'error' ELSE 'info' END FROM part
""")
def resource_severity(t: Tables) -> DataFrame:
    line = F.concat(F.lit("MemAvailable:   "), F.col("p_partkey") * 500, F.lit(" kB"))
    memory = parse_meminfo(t("part").select("p_partkey", line.alias("line")), ["p_partkey"])
    return resource_flags(memory, parse_df(disk_lines(t), ["p_partkey"]), ["p_partkey"])


@query("""
    SELECT event_id, event_type, value, CASE
        WHEN event_type = 'click' AND value < 20 THEN 'warning' WHEN event_type = 'error' AND value < 50 THEN 'error'
        WHEN event_type = 'view' AND value < 10.5 THEN 'error' ELSE 'info' END AS severity
    FROM events
""")
def threshold_severity(t: Tables) -> DataFrame:
    return threshold_flags(t("events").select("event_id", "event_type", "value"), LIMITS, metric="event_type")


def check_results(t: Tables) -> DataFrame:
    """One run per user and day; a probe fails on a high value."""
    return t("events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("date").alias("run_id"),
        F.col("event_type").alias("probe"),
        (F.col("value") > 60).alias("failed"),
    )


@query(f"""
    SELECT event_id, check_name, CASE WHEN value > 60 THEN severity ELSE 'info' END AS severity,
        value > 60 AND coalesce(counts, false) AS counts_as_failure
    FROM events LEFT JOIN {RULES_SQL} ON probe = event_type
""")
def probe_severity(t: Tables) -> DataFrame:
    return attach_severity(check_results(t), RULES).select("event_id", "check_name", "severity", "counts_as_failure")


COUNTS_SQL = f"""
    SELECT user_id, CAST(ts AS DATE) AS run_id,
        count(DISTINCT CASE WHEN value > 60 AND counts THEN check_name END) AS errors
    FROM events LEFT JOIN {RULES_SQL} ON probe = event_type GROUP BY ALL
"""
VERDICT_SQL = "CASE WHEN errors = 0 THEN 'passed' ELSE errors || ' check(s) failed' END"


@query(f"SELECT user_id, run_id, errors, {VERDICT_SQL} AS verdict FROM ({COUNTS_SQL})")
def run_verdicts(t: Tables) -> DataFrame:
    return verdict(error_count(check_results(t), RULES, ["user_id", "run_id"]))


@query("SELECT user_id, bool_or(event_type = 'purchase' AND value > 100) AS migrated FROM events GROUP BY user_id")
def any_true_per_key(t: Tables) -> DataFrame:
    flagged = t("events").withColumn("migrated", (F.col("event_type") == "purchase") & (F.col("value") > 100))
    return any_true(flagged, ["user_id"], "migrated")


def host_lines(t: Tables) -> DataFrame:
    """The whole page as a line; some carry a marker of a virtualised host."""
    html, url = F.col("html"), F.col("url")
    line = F.when(url.like("https%"), F.concat(html, F.lit(" vboxguest 1"))).otherwise(F.concat(F.lit("QEMU Virtual CPU "), html))
    source = F.when(url.like("%/en/%"), "modules").otherwise("cpuinfo")
    return t("pages").select(F.regexp_extract(url, r"^\w+://([^/]+)", 1).alias("host"), source.alias("source"), line.alias("line"))


@query(r"""
    SELECT host, bool_or(vbox) AS virtualbox, bool_or(qemu) AS virtual,
        CASE WHEN bool_or(vbox) THEN 'virtualbox' WHEN bool_or(qemu) THEN 'virtual' ELSE 'other' END AS environment
    FROM (SELECT regexp_extract(url, '^\w+://([^/]+)', 1) AS host,
        url LIKE '%/en/%' AND (url LIKE 'https%' OR contains(html, 'vboxguest')) AS vbox,
        url NOT LIKE '%/en/%' AND (url NOT LIKE 'https%' OR contains(html, 'QEMU Virtual CPU')) AS qemu FROM pages)
    GROUP BY host
""")
def host_environment(t: Tables) -> DataFrame:
    return classify_environment(host_lines(t), ["host"])


@query("""
    WITH counts AS (SELECT user_id, CAST(ts AS DATE) AS run_id, count(DISTINCT CASE WHEN value > 60 AND
            event_type IN ('error', 'click') THEN event_type END) AS errors FROM events GROUP BY ALL),
    hosts AS (SELECT user_id, bool_or(props LIKE '%7%') AS vbox FROM events GROUP BY user_id)
    SELECT user_id, run_id, errors, CASE WHEN errors = 0 THEN 'passed' ELSE errors || ' check(s) failed' END AS verdict,
        CASE WHEN errors > 0 THEN CASE WHEN vbox THEN 'virtualbox' ELSE 'other' END END AS environment
    FROM counts JOIN hosts USING (user_id)
""")
def health_reports(t: Tables) -> DataFrame:
    """With the fixed probes: errors stand for a missing runtime, clicks for an unwritable folder."""
    probe = F.when(F.col("probe") == "error", "node").when(F.col("probe") == "click", "data_writable").otherwise("dns")
    line = F.when(F.col("props").contains("7"), "vboxguest").otherwise("ext4")
    lines = t("events").select("user_id", F.lit("modules").alias("source"), line.alias("line"))
    return health_report(check_results(t).withColumn("probe", probe), lines, ["user_id", "run_id"])


def log_text() -> Column:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("["), time, F.lit("] "), level, F.lit(": type "), "event_type", F.lit(" props "), "props")


@query("""
    SELECT event_id, date_trunc('second', ts) AS ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
        'type ' || event_type || ' props ' || props AS message FROM events
""")
def log_lines(t: Tables) -> DataFrame:
    parsed = parse_log_lines(t("events").select("event_id", log_text().alias("value")))
    return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    SELECT event_type AS kind, date_trunc('second', ts) AS ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
        'type ' || event_type || ' props ' || props AS message FROM events
""")
def landed_log_lines(t: Tables) -> DataFrame:
    """The same lines landed as text, in one directory per event type."""
    path = scratch_path(t.spark, "log")
    t("events").select(F.col("event_type").alias("kind"), log_text().alias("value")).write.partitionBy("kind").text(path)
    return read_log_lines(t.spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_type AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n_lines FROM events GROUP BY ALL")
def followed_log_lines(t: Tables) -> DataFrame:
    """The same lines followed as a stream, which keeps the directory of each line."""
    path = scratch_path(t.spark, "followed-log")
    lines = t("events").select(F.col("event_type").alias("kind"), log_text().alias("value"))
    lines.write.partitionBy("kind").text(f"{path}/log")
    followed = read_log_lines(t.spark, f"{path}/log", stream=True, keys="kind STRING")
    return run_to_table(followed, path).groupBy("kind", "level").agg(F.count("*").alias("n_lines"))
