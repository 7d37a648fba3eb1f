"""Declared state on the given tables.

Option documents are made from customers and state documents from orders, one JSON text per row. Package requests are
made from documents: the language stands for the installation, the source for the package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from muster.functions import append_absent, joined, remove_every, words_of
from muster.operators import (
    apply_requests,
    declared_packages,
    distinct_packages,
    empty_groups,
    list_packages,
    package_documents,
    package_line,
    package_rows,
    recorded_rows,
    remove_packages,
    remove_stored,
    replay_commands,
    request_outcome,
    requests_missing,
    resolve_launch_mode,
    store_packages,
    stored_packages,
    validate_requests,
)
from muster.plans.flows import startup_packages
from muster.schemas import CORRUPT, OPTION_KEYS, STATE_KEYS
from muster.session import scratch_path
from muster.sources import (
    parse_options,
    parse_package_state,
    read_options,
    read_package_state,
    read_package_versions,
    write_package_state,
)


def one_word(col: Column) -> Column:
    return F.array(col.cast("string"))


def option_documents(t: Tables) -> DataFrame:
    text = F.to_json(
        F.struct(
            (F.col("c_acctbal") > 0).alias("launch"),
            one_word(F.col("c_mktsegment")).alias(OPTION_KEYS["apk"]),
            one_word(F.concat(F.lit("n"), F.col("c_nationkey"))).alias(OPTION_KEYS["pip"]),
        )
    )
    has_picker = F.col("c_mktsegment") != "BUILDING"
    documents = t("customer").select(
        F.col("c_custkey").alias("installation_id"), has_picker.alias("has_picker"), text.alias("raw")
    )
    return parse_options(documents, "launch")


def state_documents(t: Tables) -> DataFrame:
    text = F.to_json(
        F.struct(
            one_word(F.col("o_orderpriority")).alias(STATE_KEYS["apk"]),
            F.array("o_orderstatus", F.concat(F.lit("n"), F.length("o_orderpriority"))).alias(STATE_KEYS["pip"]),
        )
    )
    return parse_package_state(t("orders").select(F.col("o_custkey").alias("installation_id"), text.alias("raw")))


DECLARED_SQL = """
    SELECT c_custkey AS installation_id, 'apk' AS kind, c_mktsegment AS text, 'config' AS origin FROM customer
    UNION ALL SELECT c_custkey, 'pip', 'n' || c_nationkey, 'config' FROM customer
    UNION ALL SELECT o_custkey, 'apk', o_orderpriority, 'local' FROM orders
    UNION ALL SELECT o_custkey, 'pip', o_orderstatus, 'local' FROM orders
    UNION ALL SELECT o_custkey, 'pip', 'n' || length(o_orderpriority), 'local' FROM orders
"""
WORDS_SQL = f"SELECT installation_id, kind, unnest(string_split(text, ' ')) AS package, origin FROM ({DECLARED_SQL})"


@query(f"""
    SELECT installation_id, kind, string_agg(package, ' ' ORDER BY package) AS packages
    FROM (SELECT DISTINCT installation_id, kind, package FROM ({WORDS_SQL})) GROUP BY installation_id, kind
""")
def startup_package_lines(t: Tables) -> DataFrame:
    return startup_packages(option_documents(t), state_documents(t))


@query(f"""
    SELECT installation_id, kind, package, string_agg(DISTINCT origin, ' ' ORDER BY origin) AS origin
    FROM ({WORDS_SQL}) GROUP BY installation_id, kind, package
""")
def declared_origin(t: Tables) -> DataFrame:
    configured = package_rows(option_documents(t), OPTION_KEYS)
    recorded = package_rows(state_documents(t), STATE_KEYS)
    both = declared_packages(configured, recorded)
    return both.withColumn("origin", F.array_join("origin", " "))


@query("""
    SELECT user_id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS packages FROM events GROUP BY user_id
""")
def sort_unique_join(t: Tables) -> DataFrame:
    names = t("events").select("user_id", F.lit("event").alias("kind"), F.col("event_type").alias("package"))
    return package_line(names, ["user_id"]).drop("kind")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    def nations(table: str, column: str) -> DataFrame:
        return t(table).select(F.lit("nation").alias("kind"), F.col(column).cast("string").alias("package"))

    both = declared_packages(nations("customer", "c_nationkey"), nations("supplier", "s_nationkey"), keys=())
    return both.select(F.col("package").cast("int").alias("nation"))


@query(r"""
    SELECT DISTINCT source, word FROM (
        SELECT source, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS word FROM documents
    ) WHERE word <> ''
""")
def token_distinct(t: Tables) -> DataFrame:
    words = t("documents").select("source", F.explode(words_of(F.col("text"))).alias("package"))
    return distinct_packages(words, ["source"]).select("source", F.col("package").alias("word"))


@query("""
    SELECT c_custkey AS installation_id, c_acctbal > 0 AS auto_launch,
        CASE WHEN c_acctbal > 0 THEN 'auto' WHEN c_mktsegment <> 'BUILDING' THEN 'picker' ELSE 'auto_fallback' END AS launch_mode
    FROM customer
""")
def launch_mode(t: Tables) -> DataFrame:
    modes = resolve_launch_mode(option_documents(t), F.col("has_picker"))
    return modes.select("installation_id", "auto_launch", "launch_mode")


@query("""
    SELECT doc_id, CASE WHEN n_chars > 1000 THEN 2 ELSE 0 END AS n_packages, n_chars <= 1000 AS is_corrupt FROM documents
""")
def state_documents_with_corrupt(t: Tables) -> DataFrame:
    valid = F.to_json(F.struct(F.array("lang", "source").alias(STATE_KEYS["pip"])))
    raw = F.when(F.col("n_chars") > 1000, valid).otherwise(F.concat(F.lit("text: "), "text"))
    parsed = parse_package_state(t("documents").select("doc_id", raw.alias("raw")))
    packages = F.concat(*STATE_KEYS.values())
    return parsed.select("doc_id", F.size(packages).alias("n_packages"), F.col(CORRUPT).isNotNull().alias("is_corrupt"))


LISTED_SQL = """
    SELECT p_partkey, 'apk' AS kind, 0 AS pos, p_type AS package FROM part WHERE p_size > 25
    UNION ALL SELECT p_partkey, 'apk', 1, p_brand FROM part WHERE p_size > 25
    UNION ALL SELECT p_partkey, 'apk', NULL, '(none)' FROM part WHERE p_size <= 25
    UNION ALL SELECT p_partkey, 'pip', 0, p_name FROM part
"""


@query(LISTED_SQL)
def package_listing(t: Tables) -> DataFrame:
    apk = F.when(F.col("p_size") > 25, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>"))
    raw = F.to_json(F.struct(apk.alias(STATE_KEYS["apk"]), F.array("p_name").alias(STATE_KEYS["pip"])))
    return list_packages(parse_package_state(t("part").select("p_partkey", raw.alias("raw"))), ["p_partkey"])


def package_requests(t: Tables) -> DataFrame:
    """Requests in order of the document; long documents ask in capitals, middle ones for the other kind."""
    return t("documents").select(
        F.col("lang").alias("installation_id"),
        F.col("doc_id").alias("request_seq"),
        F.lit(0).alias("pos"),
        F.when(F.col("n_chars") < 1500, "apk").otherwise("pip").alias("kind"),
        F.when(F.col("n_chars") > 1000, F.upper("source")).otherwise(F.col("source")).alias("package"),
    )


# Fixed values of this binding: the languages of the documents.
LANGUAGES = ("de", "en", "es", "fr")


def package_state(t: Tables) -> DataFrame:
    """The source of each document is recorded, for another language's installation; whose, follows from its length."""
    shifted = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("n_chars") % 4 + 1).cast("int"))
    return (
        t("documents")
        .select(
            shifted.alias("installation_id"),
            F.when(F.col("n_chars") % 3 == 0, "apk").otherwise("pip").alias("kind"),
            F.concat(F.col("source"), F.when(F.col("n_chars") % 5 > 0, "0").otherwise("")).alias("package"),
        )
        .dropDuplicates()
    )


REQUESTS_SQL = """
    SELECT lang AS installation_id, doc_id AS request_seq, CASE WHEN n_chars < 1500 THEN 'apk' ELSE 'pip' END AS kind,
        CASE WHEN n_chars > 1000 THEN upper(source) ELSE source END AS package,
        CASE WHEN n_chars < 1500 THEN package ELSE lower(package) END AS match
    FROM documents
"""
STATE_SQL = """
    SELECT DISTINCT ['de', 'en', 'es', 'fr'][n_chars % 4 + 1] AS installation_id,
        CASE WHEN n_chars % 3 = 0 THEN 'apk' ELSE 'pip' END AS kind,
        source || CASE WHEN n_chars % 5 > 0 THEN '0' ELSE '' END AS package,
        CASE WHEN n_chars % 3 = 0 THEN package ELSE lower(package) END AS match
    FROM documents
"""


@query(f"""
    SELECT installation_id, request_seq, kind, package FROM ({REQUESTS_SQL}) r
    WHERE NOT EXISTS (
        SELECT 1 FROM ({STATE_SQL}) s
        WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.package = r.package
    )
""")
def missing_exact(t: Tables) -> DataFrame:
    return requests_missing(package_requests(t), package_state(t), folded=()).drop("pos")


@query(f"""
    SELECT installation_id, request_seq, kind, package FROM ({REQUESTS_SQL}) r
    WHERE NOT EXISTS (
        SELECT 1 FROM ({STATE_SQL}) s
        WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.match = r.match
    )
""")
def missing_folded(t: Tables) -> DataFrame:
    return requests_missing(package_requests(t), package_state(t)).drop("pos")


@query(f"""
    SELECT installation_id, kind, package FROM ({REQUESTS_SQL}) r
    WHERE NOT EXISTS (
        SELECT 1 FROM ({STATE_SQL}) s
        WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.package = r.package
    )
""")
def remove_exact(t: Tables) -> DataFrame:
    recorded = package_requests(t).select("installation_id", "kind", "package")
    return remove_packages(recorded, package_state(t))


@query(f"""
    SELECT installation_id, request_seq, kind, package,
        CASE WHEN request_seq = min(request_seq) OVER (PARTITION BY installation_id, kind, match)
            AND NOT EXISTS (
                SELECT 1 FROM ({STATE_SQL}) s
                WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.match = r.match
            ) THEN 'added' ELSE 'present' END AS outcome
    FROM ({REQUESTS_SQL}) r
""")
def request_outcomes(t: Tables) -> DataFrame:
    return request_outcome(package_requests(t), package_state(t)).drop("pos")


APPLIED_SQL = f"""
    SELECT installation_id, kind, package FROM ({STATE_SQL})
    UNION ALL
    SELECT installation_id, kind, arg_min(package, request_seq) FROM ({REQUESTS_SQL}) r
    WHERE NOT EXISTS (
        SELECT 1 FROM ({STATE_SQL}) s
        WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.match = r.match
    ) GROUP BY installation_id, kind, match
"""


@query(APPLIED_SQL)
def requests_applied(t: Tables) -> DataFrame:
    return apply_requests(package_state(t), package_requests(t))


@query(APPLIED_SQL)
def state_versions(t: Tables) -> DataFrame:
    """The same through two stored versions: the recorded packages, and those after the requests."""
    path = scratch_path(t.spark, "package-state")
    write_package_state(package_state(t), path, 1)
    write_package_state(apply_requests(read_package_versions(t.spark, path), package_requests(t)), path, 2)
    return read_package_versions(t.spark, path)


def stored_state(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stored-packages")
    store_packages(package_state(t), path, 1)
    return stored_packages(t.spark, path)


@query(f"""
    SELECT installation_id, request_seq, kind, package FROM ({REQUESTS_SQL}) r
    WHERE NOT EXISTS (
        SELECT 1 FROM ({STATE_SQL}) s
        WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.match = r.match
    )
""")
def missing_stored(t: Tables) -> DataFrame:
    """Requests against packages stored by buckets."""
    return requests_missing(package_requests(t), stored_state(t)).drop("pos")


@query(f"""
    SELECT installation_id, kind, package FROM ({STATE_SQL}) s
    WHERE NOT EXISTS (
        SELECT 1 FROM ({REQUESTS_SQL}) r
        WHERE s.installation_id = r.installation_id AND s.kind = r.kind AND s.package = r.package
    )
""")
def removed_stored(t: Tables) -> DataFrame:
    return remove_stored(stored_state(t), package_requests(t)).drop("_match")


@query(APPLIED_SQL)
def applied_stored(t: Tables) -> DataFrame:
    """Requests applied to stored packages, stored as the next version and read from there."""
    path = scratch_path(t.spark, "stored-packages")
    store_packages(package_state(t), path, 1)
    store_packages(apply_requests(stored_packages(t.spark, path), package_requests(t)), path, 2)
    return stored_packages(t.spark, path).drop("_match")


@query("""
    WITH lists AS (
        SELECT doc_id, 'apk' AS kind, list_filter([source, lang] || CASE WHEN n_chars % 2 = 0 THEN ['SRC1'] ELSE [] END,
            lambda x: x <> 'en') AS entries FROM documents
        UNION ALL
        SELECT doc_id, 'pip', [source] || CASE WHEN n_chars % 2 = 1 AND source <> 'src1' THEN ['SRC1'] ELSE [] END FROM documents
    )
    SELECT doc_id, kind, CASE WHEN len(entries) > 0 THEN unnest(range(len(entries)))::INTEGER END AS pos,
        CASE WHEN len(entries) > 0 THEN unnest(entries) ELSE '(none)' END AS package FROM lists
""")
def documents_edited(t: Tables) -> DataFrame:
    """State documents read, edited by requests through stored versions, written as documents and listed again."""
    path, key = scratch_path(t.spark, "documents-edited"), ["doc_id"]
    lists = F.struct(F.array("source", "lang").alias("apk_packages"), F.array("source").alias("pip_packages"))
    texts = t("documents").select("doc_id", F.to_json(lists).alias("raw"))
    columns = "doc_id BIGINT, package STRING, pos INT"
    write_package_state(recorded_rows(parse_package_state(texts), keys=key), path, 1)
    kind = F.when(F.col("n_chars") % 2 == 0, "apk").otherwise("pip").alias("kind")
    number = F.lit(1).alias("request_seq")
    additions = t("documents").select("doc_id", kind, F.lit("SRC1").alias("package"), number, F.lit(0).alias("pos"))
    removals = t("documents").select("doc_id", F.lit("apk").alias("kind"), F.lit("en").alias("package"))
    state = read_package_versions(t.spark, path, columns=columns)
    grown = apply_requests(state, additions, key, position="pos")
    write_package_state(remove_packages(grown, removals, key), path, 2)
    stored = read_package_versions(t.spark, path, columns=columns)
    return list_packages(parse_package_state(package_documents(stored, key)), key)


@query("""
    SELECT lang AS installation_id, kind, string_agg(DISTINCT package, ' ' ORDER BY package) AS packages FROM (
        SELECT lang, 'apk' AS kind, source AS package FROM documents
        UNION ALL SELECT lang, 'pip', lang || n_chars % 10 FROM documents) GROUP BY ALL
""")
def startup_from_files(t: Tables) -> DataFrame:
    """Option and state documents landed as lines below a directory per installation, and read by path.

    A path where nothing has landed counts as empty documents.
    """
    path = scratch_path(t.spark, "landed-documents")
    key = F.col("lang").alias("installation_id")
    options = F.to_json(F.struct(F.array("source").alias("persistent_apk_packages")))
    state = F.to_json(F.struct(F.array(F.concat("lang", F.col("n_chars") % 10)).alias("pip_packages")))
    for name, text in (("options", options), ("state", state)):
        t("documents").select(key, text.alias("value")).write.partitionBy("installation_id").text(f"{path}/{name}")
    declared = read_options(t.spark, f"{path}/options", "launch", per_line=True)
    recorded = read_package_state(t.spark, f"{path}/state", per_line=True)
    nothing = read_package_state(t.spark, f"{path}/nowhere")
    return startup_packages(declared, recorded.unionByName(nothing))


# Fixed values of this binding: the command and the spelling each event type stands for.
COMMANDS = {
    "click": ("add", "Tool"),
    "view": ("add", "tool"),
    "purchase": ("add", "TOOL"),
    "error": ("remove", "Tool"),
    "signup": ("remove", "tool"),
}
STEP_SQL = """
    SELECT user_id, CASE WHEN value < 100 THEN 'pip' ELSE 'apk' END AS kind,
        CASE WHEN event_type IN ('error', 'signup') THEN 'remove' ELSE 'add' END AS op,
        CASE event_type WHEN 'click' THEN 'Tool' WHEN 'error' THEN 'Tool' WHEN 'purchase' THEN 'TOOL' ELSE 'tool' END AS package,
        row_number() OVER (PARTITION BY user_id, value < 100 ORDER BY event_id) AS n
    FROM events
"""


@query(f"""
    WITH RECURSIVE steps AS MATERIALIZED ({STEP_SQL}),
    pip AS (
        SELECT user_id, 0::BIGINT AS n, 'Tool' AS held FROM (SELECT DISTINCT user_id FROM steps)
        UNION ALL
        SELECT s.user_id, s.n, CASE
            WHEN op = 'add' AND held = '' THEN package WHEN op = 'remove' AND held = package THEN '' ELSE held END
        FROM pip JOIN steps s ON s.user_id = pip.user_id AND s.n = pip.n + 1 AND s.kind = 'pip'
    )
    SELECT user_id, 'pip' AS kind, arg_max(held, n) AS package FROM pip GROUP BY user_id HAVING arg_max(held, n) <> ''
    UNION ALL
    SELECT user_id, 'apk', package FROM steps WHERE kind = 'apk' GROUP BY user_id, package HAVING arg_max(op, n) = 'add'
""")
def commands_replayed(t: Tables) -> DataFrame:
    events = t("events")
    op, package = F.lit(None), F.lit(None)
    for event_type, (command, name) in COMMANDS.items():
        op = F.when(F.col("event_type") == event_type, command).otherwise(op)
        package = F.when(F.col("event_type") == event_type, name).otherwise(package)
    commands = events.select(
        "user_id",
        F.when(F.col("value") < 100, "pip").otherwise("apk").alias("kind"),
        op.alias("op"),
        package.alias("package"),
        F.col("event_id").alias("request_seq"),
        F.lit(0).alias("pos"),
    )
    recorded = events.select("user_id", F.lit("pip").alias("kind"), F.lit("Tool").alias("package")).dropDuplicates()
    return replay_commands(recorded, commands, ["user_id"])


@query("""
    WITH requests AS (
        SELECT event_id,
            CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'remove' WHEN 'error' THEN 'upgrade' WHEN 'signup' THEN 'add' END AS op,
            CASE WHEN value < 20 THEN 'apk' WHEN value < 40 THEN 'pip' WHEN value < 60 THEN 'npm' END AS kind,
            CASE WHEN value < 10 THEN '' WHEN value < 50 THEN props END AS package
        FROM events
    )
    SELECT event_id, coalesce(op, 'help') AS op, CASE
        WHEN op = 'upgrade' THEN 'unknown command'
        WHEN op = 'add' AND (kind IS NULL OR kind = 'npm') THEN 'unknown command'
        WHEN op = 'add' AND coalesce(package, '') = '' THEN 'no packages specified'
        WHEN op = 'remove' AND (kind IS NULL OR coalesce(package, '') = '') THEN 'missing arguments'
        WHEN op = 'remove' AND kind = 'npm' THEN 'unknown package type' END AS reason
    FROM requests
""")
def requests_validated(t: Tables) -> DataFrame:
    event_type, value = F.col("event_type"), F.col("value")
    op = F.when(event_type.isin("click", "signup"), "add").when(event_type == "view", "remove").when(event_type == "error", "upgrade")
    requests = t("events").select(
        "event_id",
        op.alias("op"),
        F.when(value < 20, "apk").when(value < 40, "pip").when(value < 60, "npm").alias("kind"),
        F.when(value < 10, "").when(value < 50, F.col("props")).alias("package"),
    )
    return validate_requests(requests).select("event_id", "op", "reason")


@query("""
    SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS is_empty FROM customer
""")
def customers_without_orders(t: Tables) -> DataFrame:
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return empty_groups(t("customer").select("c_custkey"), orders, ["c_custkey"])


@query("""
    SELECT doc_id, lang || CASE WHEN source = lang THEN '' ELSE ' ' || source END || CASE WHEN source = 'src1' THEN '' ELSE ' src1' END
        AS appended, lang || ' ' || source || CASE WHEN source = 'src1' THEN '' ELSE ' SRC1' END AS folded,
        CASE WHEN lang = 'en' THEN source ELSE lang || ' ' || source END AS removed FROM documents
""")
def list_edits(t: Tables) -> DataFrame:
    """Lists of one document each, edited in place."""
    words = F.array("lang", "source")
    return t("documents").select(
        "doc_id",
        joined(append_absent(words, F.lit("src1"))).alias("appended"),
        joined(append_absent(words, F.lit("SRC1"), fold=True)).alias("folded"),
        joined(remove_every(words, F.lit("en"))).alias("removed"),
    )
