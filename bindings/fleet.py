"""Fleet-wide counts and averages on events and line items."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from muster.operators import average_states, compare_sets, installation_sketches, package_prevalence, severity_counts
from muster.session import scratch_path


@query("""
    SELECT event_type, user_id, count(DISTINCT CAST(ts AS DATE)) AS installations, grouping_id(event_type, user_id) AS level
    FROM events GROUP BY ROLLUP (event_type, user_id)
""")
def prevalence_rollup(t: Tables) -> DataFrame:
    days = t("events").select("event_type", "user_id", F.col("ts").cast("date").alias("day"))
    return package_prevalence(days, ["event_type", "user_id"], "day")


@query("""
    SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS installations,
        grouping_id(l_returnflag, l_linestatus) AS level, true AS is_close
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def prevalence_estimate(t: Tables) -> DataFrame:
    """Whether counts from sketches of fixed size are within a tenth of the exact ones."""
    dimensions = ["l_returnflag", "l_linestatus"]
    exact = package_prevalence(t("lineitem"), dimensions, "l_partkey")
    estimates = package_prevalence(t("lineitem"), dimensions, "l_partkey", approx=True).select(
        *[F.col(name).alias(f"_{name}") for name in [*dimensions, "level"]], F.col("installations").alias("estimate")
    )
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in [*dimensions, "level"]]
    is_close = F.abs(F.col("estimate") - F.col("installations")) <= 0.1 * F.col("installations")
    joined = exact.join(estimates, same[0] & same[1] & same[2], "left")
    return joined.select(*exact.columns, F.coalesce(is_close, F.lit(False)).alias("is_close"))


@query("""
    SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS installations,
        grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def prevalence_cube(t: Tables) -> DataFrame:
    return package_prevalence(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey", cube=True)


@query("""
    SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'error' THEN 1 END) AS error,
        count(CASE WHEN event_type = 'view' THEN 1 END) AS view, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase,
        count(CASE WHEN event_type NOT IN ('click', 'error', 'view', 'purchase') THEN 1 END) AS other FROM events GROUP BY user_id
""")
def severity_count_list(t: Tables) -> DataFrame:
    return severity_counts(t("events"), ["user_id"], "event_type", ["click", "error", "view", "purchase"])


def hundredths(col: str) -> Column:
    """Whole hundredths as text, so that sums of states do not depend on their order."""
    return F.round(F.col(col) * 100).cast("bigint").cast("string")


@query("""
    SELECT date_trunc('day', ts) AS window_start, user_id,
        avg(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS DOUBLE) END) AS average,
        count(CASE WHEN event_type <> 'error' THEN 1 END) AS n_states
    FROM events GROUP BY ALL
""")
def window_average(t: Tables) -> DataFrame:
    """Errors stand for a state that is no number."""
    state = F.when(F.col("event_type") == "error", "unavailable").otherwise(hundredths("value"))
    averages = average_states(t("events").withColumn("state", state), ["user_id"], timedelta(days=1))
    return averages.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    SELECT window_start, event_type, avg(CAST(round(value * 100) AS DOUBLE)) AS average, count(*) AS n_states FROM (
        SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'),
            time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS window_start FROM events)
    GROUP BY ALL
""")
def sliding_average(t: Tables) -> DataFrame:
    states = t("events").withColumn("state", hundredths("value"))
    averages = average_states(states, ["event_type"], timedelta(hours=12), timedelta(hours=6))
    return averages.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    WITH holds AS (SELECT DISTINCT l_linenumber AS package, l_partkey FROM lineitem),
    numbers AS (SELECT DISTINCT package FROM holds)
    SELECT a.package AS first, b.package AS second,
        (SELECT count(*) FROM holds x JOIN holds y USING (l_partkey) WHERE x.package = a.package AND y.package = b.package) AS both,
        (SELECT count(*) FROM holds x WHERE x.package = a.package) AS firsts,
        (SELECT count(*) FROM holds x WHERE x.package = b.package) AS seconds, true AS is_close
    FROM numbers a JOIN numbers b ON a.package <> b.package
""")
def set_comparison(t: Tables) -> DataFrame:
    """Line numbers stand for packages, parts for installations. Sketches land in three steps, one per return flag.

    Whether what sketches say about pairs is within a twentieth of the exact numbers.
    """
    path = scratch_path(t.spark, "sketches")
    lines = t("lineitem").select(F.col("l_linenumber").alias("package"), "l_returnflag", "l_partkey")
    for flag in ("A", "N", "R"):
        landed = installation_sketches(lines.filter(F.col("l_returnflag") == flag), ["l_returnflag", "package"], "l_partkey")
        landed.write.mode("append").parquet(path)
    held = lines.select("package", "l_partkey").distinct()
    numbers = held.groupBy("package").agg(F.count("*").alias("n"))
    two = held.select(F.col("package").alias("second"), "l_partkey")
    exact = (
        held.withColumnRenamed("package", "first").join(two, "l_partkey").filter("first <> second")
        .groupBy("first", "second").agg(F.count("*").alias("both"))
        .join(numbers.select(F.col("package").alias("first"), F.col("n").alias("firsts")), "first")
        .join(numbers.select(F.col("package").alias("second"), F.col("n").alias("seconds")), "second")
    )
    sketched = compare_sets(t.spark.read.parquet(path), exact.select("first", "second"))
    sketched = sketched.select("first", "second", F.col("both").alias("_both"), "only_first", "either")
    either = F.col("firsts") + F.col("seconds") - F.col("both")

    def near(name: str, value: Column) -> Column:
        return F.abs(F.col(name) - value) <= 0.05 * either

    is_close = near("_both", F.col("both")) & near("only_first", F.col("firsts") - F.col("both")) & near("either", either)
    return exact.join(sketched, ["first", "second"]).select(*exact.columns, is_close.alias("is_close"))
