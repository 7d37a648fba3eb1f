"""Declared state: package lists that are united, appended to, deleted from and listed.

Package rows are `(keys…, kind, package)`. Names of kinds in `folded` are compared without ASCII case when they are
added, and exactly when they are removed or united.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.lists import joined, words_of
from muster.functions.text import ascii_lower, blank_to, has_value
from muster.plans.hot import lookup
from muster.schemas import COMMANDS, DEFAULT_COMMAND, FOLDED_KINDS, HELP_OPTIONS, KINDS, STATE_KEYS
from muster.session import checkpointed, written

KEYS = ("installation_id",)
MATCH = "_match"


def match_name(kind: Column, package: Column, folded: Sequence[str] = FOLDED_KINDS) -> Column:
    """The name under which a package is looked up when it is added."""
    return F.when(kind.isin(*folded), ascii_lower(package)).otherwise(package)


def matched(df: DataFrame, folded: Sequence[str]) -> DataFrame:
    """Add the name under which a package is looked up; stored rows have it."""
    if MATCH in df.columns:
        return df
    return df.withColumn(MATCH, match_name(F.col("kind"), F.col("package"), folded))


# Rows from documents


def package_rows(documents: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per word of the array columns in `columns`, which maps a kind to its column.

    A list whose whole text is empty or `null` has no value; an entry with blanks counts as several words.
    """
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.array_join(column, "\n").alias("text"))
        for kind, column in columns.items()
    ]
    lists = documents.select(*keys, F.inline(F.array(*pairs))).filter(has_value(F.col("text")))
    words = lists.select(*keys, "kind", F.explode(words_of(F.col("text"))).alias("package"))
    return words.filter(F.col("package") != "")


def recorded_rows(
    documents: DataFrame, columns: Mapping[str, str] = STATE_KEYS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per array entry as it is, with its position; blanks inside an entry are kept."""
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("entries")) for kind, column in columns.items()]
    )
    lists = documents.select(*keys, F.inline(pairs))
    return lists.select(*keys, "kind", F.posexplode("entries").alias("pos", "package"))


# Union, distinct, join to text


def distinct_packages(df: DataFrame, keys: Sequence[str] = (*KEYS, "kind")) -> DataFrame:
    """Distinct non-empty names per key, case-sensitive."""
    return df.select(*keys, "package").filter(F.col("package") != "").dropDuplicates()


def declared_packages(configured: DataFrame, recorded: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of configured and recorded packages, one row per name, with where each comes from in `origin`.

    Duplicates are merged before the shuffle, also those of a key that holds most rows.
    """
    both = (
        configured.select(*keys, "kind", "package")
        .withColumn("configured", F.lit(True))
        .unionByName(recorded.select(*keys, "kind", "package").withColumn("configured", F.lit(False)))
        .filter(F.col("package") != "")
    )
    flags = both.groupBy(*keys, "kind", "package").agg(
        F.bool_or("configured").alias("in_config"), F.bool_or(~F.col("configured")).alias("in_local")
    )
    origin = F.array_compact(F.array(F.when(F.col("in_config"), "config"), F.when(F.col("in_local"), "local")))
    return flags.select(*keys, "kind", "package", origin.alias("origin"))


def package_line(packages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct names per key and kind in binary order, joined with one blank.

    Names are made distinct in a shuffle on the name first, so that one task receives each name of a list once, no
    matter how many rows declared it.
    """
    names = distinct_packages(packages, [*keys, "kind"])
    line = joined(F.array_sort(F.collect_list("package")))
    return names.groupBy(*keys, "kind").agg(line.alias("packages"))


def empty_groups(groups: DataFrame, members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every row of `groups` with `is_empty`: no member row has its keys."""
    counts = members.groupBy(*keys).agg(F.count("*").alias("_members"))
    return groups.join(counts, list(keys), "left").withColumn("is_empty", F.col("_members").isNull()).drop("_members")


def list_packages(documents: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recorded packages per kind, `(none)` for an empty list, as `(keys…, kind, pos, package)` in stored order."""
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("entries")) for kind, column in STATE_KEYS.items()]
    )
    lists = documents.select(*keys, F.inline(pairs))
    entries = lists.select(*keys, "kind", F.posexplode_outer("entries").alias("pos", "package"))
    return entries.withColumn("package", F.coalesce("package", F.lit("(none)")))


# Requests


def validate_requests(requests: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Add `reason`, NULL for a valid request. `op` is one of add, remove, list, help; a missing one, or an option that
    asks for help, is help."""
    given = blank_to(F.col("op"), F.lit(DEFAULT_COMMAND))
    op = F.when(given.isin(*HELP_OPTIONS), DEFAULT_COMMAND).otherwise(given)
    kind, package = F.nullif(F.col("kind"), F.lit("")), F.nullif(F.col("package"), F.lit(""))
    known = F.coalesce(kind.isin(*kinds), F.lit(False))
    reason = (
        F.when(~op.isin(*COMMANDS), "unknown command")
        .when((op == "add") & ~known, "unknown command")
        .when((op == "add") & package.isNull(), "no packages specified")
        .when((op == "remove") & (kind.isNull() | package.isNull()), "missing arguments")
        .when((op == "remove") & ~known, "unknown package type")
    )
    return requests.withColumn("op", op).withColumn("reason", reason)


def valid_requests(requests: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Requests that change state: valid, and for additions installed successfully."""
    checked = validate_requests(requests, kinds).filter(F.col("reason").isNull()).drop("reason")
    return checked.filter((F.col("op") == "remove") | ((F.col("op") == "add") & F.col("install_ok")))


def requests_missing(
    requests: DataFrame, state: DataFrame, keys: Sequence[str] = KEYS, folded: Sequence[str] = FOLDED_KINDS
) -> DataFrame:
    """Requested rows whose package is not recorded."""
    on = [*keys, "kind", MATCH]
    known = matched(state, folded).select(*on).dropDuplicates()
    return lookup(matched(requests, folded), known, on, "left_anti").drop(MATCH)


def remove_packages(state: DataFrame, removals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recorded rows that no removal names exactly; the others keep their multiplicity."""
    on = [*keys, "kind", "package"]
    return lookup(state, removals.select(*on).dropDuplicates(), on, "left_anti")


def first_requests(requests: DataFrame, keys: Sequence[str], order: Sequence[str], folded: Sequence[str]) -> DataFrame:
    """Per looked-up name the position and spelling of its first request, merged before the shuffle."""
    position = F.struct(*order)
    return (
        matched(requests, folded)
        .groupBy(*keys, "kind", MATCH)
        .agg(F.min(position).alias("_first"), F.min_by("package", position).alias("package"))
    )


def request_outcome(
    requests: DataFrame,
    state: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("request_seq", "pos"),
    folded: Sequence[str] = FOLDED_KINDS,
) -> DataFrame:
    """Every addition request with `outcome`: `added` for the first one of an unrecorded package, else `present`.

    What is known about a name is settled once per name and looked up for its requests.
    """
    on = [*keys, "kind", MATCH]
    known = matched(state, folded).select(*on).dropDuplicates().withColumn("_known", F.lit(True))
    names = first_requests(requests, keys, order, folded).drop("package").join(known, on, "left")
    added = F.col("_known").isNull() & (F.col("_first") == F.struct(*order))
    return (
        lookup(matched(requests, folded), names, on)
        .withColumn("outcome", F.when(added, "added").otherwise("present"))
        .drop(MATCH, "_known", "_first")
    )


def apply_requests(
    state: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("request_seq", "pos"),
    folded: Sequence[str] = FOLDED_KINDS,
    position: str | None = None,
) -> DataFrame:
    """Recorded rows plus each requested package that is absent, in the spelling of its first request.

    With `position`, the column of `state` that orders a list, new packages follow the recorded ones in the order of
    their requests; a list belongs to one document, so its new packages are numbered in one task.
    """
    on = [*keys, "kind", MATCH]
    known = matched(state, folded).select(*on).dropDuplicates()
    new = first_requests(requests, keys, order, folded).join(known, on, "left_anti")
    columns = [*keys, "kind", "package"]
    if position is None:
        return state.select(*columns).unionByName(new.select(*columns))
    lists = [*keys, "kind"]
    number = F.row_number().over(Window.partitionBy(*lists).orderBy("_first"))
    ends = state.groupBy(*lists).agg((F.max(position) + 1).alias("_end"))
    numbered = new.withColumn("_number", number).join(ends, lists, "left")
    place = (F.coalesce("_end", F.lit(0)) + F.col("_number") - 1).cast(state.schema[position].dataType)
    return state.select(*columns, position).unionByName(numbered.select(*columns, place.alias(position)))


def package_documents(
    state: DataFrame, keys: Sequence[str] = KEYS, position: str = "pos", raw: str = "raw"
) -> DataFrame:
    """One state document per key as JSON text, each list in the order of `position`."""
    lists = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(position, "package")))),
            lambda entry: entry["package"],
        ).alias(column)
        for kind, column in STATE_KEYS.items()
    ]
    columns = list(STATE_KEYS.values())
    return state.groupBy(*keys).agg(*lists).select(*keys, F.to_json(F.struct(*columns)).alias(raw))


# A log that mixes additions and removals

# Commands of one name that are followed by one task, and chunks of one name that are put together by one task.
CHUNK = 10_000
WIDER = 1_000


def chunked(commands: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """Add `_chunk`, and tell how many there are at most.

    A name with at most `CHUNK` commands is one chunk. The commands of other names are cut into ranges of about `CHUNK`
    rows in order of name and position, whatever the position is made of; they are written once, so that a range keeps
    its rows.
    """
    many = commands.filter(F.col("_commands") > CHUNK)
    rows = many.count()
    few = commands.filter(F.coalesce(F.col("_commands") <= CHUNK, F.lit(True)))
    single = few.withColumn("_chunk", F.lit(0).cast("bigint")).repartition(*group)
    if not rows:
        return single, 1
    chunks = -(-rows // CHUNK)
    ranges = many.repartitionByRange(chunks, *group, *order)
    return single.unionByName(checkpointed(ranges.withColumn("_chunk", F.spark_partition_id().cast("bigint")))), chunks


def follow_commands(commands: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What the commands of one chunk do to a name, one row per name and chunk.

    A name has one spelling recorded or none (empty text). A command changes one particular spelling: an addition turns
    none into its own, a removal its own into none. `_moves` maps each spelling some command starts from to the one it
    has become at the end of the chunk; any other spelling stays.
    """
    added = F.col("op") == "add"
    command = F.struct(
        *order,
        F.when(added, F.lit("")).otherwise(F.col("package")).alias("start"),
        F.when(added, F.col("package")).otherwise(F.lit("")).alias("end"),
    )
    listed = (
        commands.select(*group, "_chunk", command.alias("_command"))
        .groupBy(*group, "_chunk")
        .agg(F.array_sort(F.collect_list("_command")).alias("_commands"))
    )

    def follow(spelling: Column) -> Column:
        end = F.aggregate("_commands", spelling, lambda now, c: F.when(c["start"] == now, c["end"]).otherwise(now))
        return F.struct(spelling.alias("start"), end.alias("end"))

    starts = F.array_distinct(F.transform("_commands", lambda c: c["start"]))
    return listed.select(*group, "_chunk", F.transform(starts, follow).alias("_moves"))


def follow_chunks(chunks: DataFrame, group: Sequence[str], chunk: Column) -> DataFrame:
    """The moves of several consecutive chunks as those of one."""
    in_order = F.array_sort(F.collect_list(F.struct("_chunk", "_moves")))
    listed = chunks.groupBy(*group, chunk.alias("_wider")).agg(in_order.alias("_chunks"))

    def follow(spelling: Column) -> Column:
        def move(now: Column, item: Column) -> Column:
            found = F.filter(item["_moves"], lambda entry: entry["start"] == now)
            return F.coalesce(F.get(found, F.lit(0))["end"], now)

        return F.struct(spelling.alias("start"), F.aggregate("_chunks", spelling, move).alias("end"))

    starts = F.flatten(F.transform("_chunks", lambda item: F.transform(item["_moves"], lambda entry: entry["start"])))
    return listed.select(
        *group, F.col("_wider").alias("_chunk"), F.transform(F.array_distinct(starts), follow).alias("_moves")
    )


def replay_folded(commands: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Final spelling per name that starts unrecorded, for kinds added without case but removed exactly.

    Following moves is associative, so it is done over chunks of commands, then over `WIDER` chunks, and so on until one
    is left: no task receives the whole history of a name that is requested very often.
    """
    rows, left = chunked(commands, group, order)
    moves = follow_commands(rows, group, order)
    while left > 1:
        step = max(2, WIDER)
        moves = follow_chunks(moves, group, F.call_function("div", F.col("_chunk"), F.lit(step).cast("bigint")))
        left = -(-left // step)
    unrecorded = F.filter("_moves", lambda entry: entry["start"] == "")
    final = F.get(unrecorded, F.lit(0))["end"]
    return moves.select(*group, F.nullif(final, F.lit("")).alias("package"))


def replay_commands(
    state: DataFrame,
    commands: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("request_seq", "pos"),
    folded: Sequence[str] = FOLDED_KINDS,
) -> DataFrame:
    """Recorded rows after a log of additions and removals, each command seeing the result of the one before.

    An addition does nothing while a spelling of the name is recorded. So recorded spellings that are never removed
    survive and shut out every addition; only if all are removed do the commands after the last of those removals count.
    For exact names the last command then decides. The log is written once and read from there, so what made it runs
    once.
    """
    columns = [*keys, "kind", "package"]
    group = [*keys, "kind", MATCH]
    position = F.struct(*order)
    log = written(matched(commands.select(*columns, "op", *order), folded), "commands")
    spellings = log.groupBy(*group, "package").agg(
        F.count("*").alias("_commands"),
        F.min(F.when(F.col("op") == "remove", position)).alias("_removed"),
        F.max(F.struct(*order, "op")).alias("_last"),
    )
    spellings = written(spellings, "spellings")
    removed = spellings.select(*group, "package", "_removed")
    fate = lookup(matched(state.select(*columns), folded), removed, [*group, "package"])
    survivors = fate.filter(F.col("_removed").isNull()).select(*columns)
    recorded = fate.groupBy(*group).agg(
        F.bool_or(F.col("_removed").isNull()).alias("_alive"), F.max("_removed").alias("_emptied")
    )
    free = F.col("_alive").isNull() | ~F.col("_alive")
    is_folded = F.col("kind").isin(*folded)
    exact = (
        spellings.filter(~is_folded & (F.col("_last.op") == "add"))
        .join(recorded, group, "left")
        .filter(free)
        .select(*columns)
    )
    names = (
        spellings.filter(is_folded)
        .groupBy(*group)
        .agg(F.sum("_commands").alias("_commands"))
        .join(recorded, group, "left")
    )
    after = F.col("_emptied").isNull() | (position > F.col("_emptied"))
    counting = lookup(log.filter(is_folded), names, group).filter(free & after)
    spelled = replay_folded(counting, group, order).filter(F.col("package").isNotNull())
    return survivors.unionByName(exact).unionByName(spelled.select(*columns))
