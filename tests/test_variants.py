import json

from muster.operators import compare_sets, explode_paths, first_path, installation_sketches, project_fields, project_paths, schema_of_replies

REPLIES = "installation_id string, endpoint string, payload string"


def replies(spark):
    addons = [{"slug": "a", "n": 1}, {"slug": "b", "n": "two"}, {"n": 3}]
    texts = [
        ("i", "addons", json.dumps({"data": {"addons": addons, "more": {"deep": [1, 2]}}})),
        ("j", "addons", json.dumps({"data": {"addons": []}})),
        ("k", "addons", json.dumps({"data": None})),
        ("l", "addons", "no json"),
        ("m", "addons", None),
        ("n", "core", json.dumps({"data": {"addons": addons}})),
    ]
    return spark.createDataFrame(texts, REPLIES)


def test_paths(spark, rows):
    fields = {"deep": ("data.more.deep[1]", "int"), "slug": ("data.addons[0].slug", "string"), "wrong": ("data.addons", "int")}
    found = project_paths(replies(spark), "addons", fields, ["installation_id"])
    assert rows(found) == [("i", 2, "a", None), *[(k, None, None, None) for k in "jklm"]]


def test_exploded_paths(spark, rows):
    fields = {"slug": ("slug", "string"), "n": ("n", "int")}
    found = explode_paths(replies(spark), "addons", "data.addons", fields, ["installation_id"])
    assert rows(found) == [("i", "a", 1), ("i", "b", None), ("i", None, 3)]
    outer = explode_paths(replies(spark), "addons", "data.addons", fields, ["installation_id"], outer=True)
    assert rows(outer)[3:] == [(k, None, None) for k in "jklm"]
    first = first_path(replies(spark), "addons", "data.addons", fields, ["installation_id"])
    assert rows(first) == [("i", "a", 1), *[(k, None, None) for k in "jklm"]]


def test_schema_found_in_the_data(spark, rows):
    texts = [("i", "x", '{"a": 1, "b": {"c": [1.5]}}'), ("j", "x", '{"a": 2, "d": null}'), ("k", "x", "{"), ("l", "y", '{"z": 1}')]
    df = spark.createDataFrame(texts, REPLIES)
    schema = schema_of_replies(df, "x")
    assert "z" not in schema and schema.startswith("STRUCT<")
    found = project_fields(df, "x", {"a": "a", "c": "b.c", "d": "d"}, ["installation_id"], schema=schema)
    assert [(r.installation_id, r.a, r.c and float(r.c[0]), r.d) for r in found.orderBy("installation_id").collect()] == [
        ("i", 1, 1.5, None), ("j", 2, None, None), ("k", None, None, None),
    ]
    assert schema_of_replies(df, "nowhere") is None
    assert schema_of_replies(spark.createDataFrame([("i", "x", "[1]")], REPLIES), "x") is None


def test_sets_from_sketches_of_days(spark, rows):
    installs = [(f"i{n}", day, package) for n in range(500) for day in range(3) for package in "ab" if (n + day) % (3 if package == "a" else 5) == 0]
    installs += [(None, 0, "a"), ("i1", 1, "c")]
    df = spark.createDataFrame(installs, "installation_id string, day int, package string")
    stored = None
    for day in range(3):
        sketches = installation_sketches(df.filter(df.day == day), ["day", "package"])
        stored = sketches if stored is None else stored.unionByName(sketches)
    sets = {p: {i for i, _, q in installs if q == p and i} for p in "abcd"}
    pairs = [("a", "b"), ("b", "a"), ("a", "d"), ("d", "c"), ("d", "d")]
    found = compare_sets(stored, spark.createDataFrame(pairs, "first string, second string"))
    expected = [(p, q, len(sets[p] & sets[q]), len(sets[p] - sets[q]), len(sets[p] | sets[q])) for p, q in pairs]
    assert rows(found) == sorted(expected, key=repr)


def test_sliding_windows_copy_panes_and_not_rows(spark):
    """Rows are summed up per pane, and shuffled as such, before anything is copied to the windows."""
    from datetime import timedelta

    from muster.operators import average_states

    states = spark.range(1000).selectExpr("id % 3 AS k", "timestamp_seconds(id * 60) AS ts", "CAST(id AS STRING) AS state")
    found = average_states(states, ["k"], timedelta(hours=12), timedelta(hours=1))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    expand = [k for k, line in enumerate(lines) if "Expand" in line or "Generate" in line]
    exchange = [k for k, line in enumerate(lines) if "Exchange" in line]
    assert expand and len(exchange) == 2 and max(expand) < max(exchange)
    by_windows = {(row.window_start, row.k): (row.average, row.n_states) for row in found.collect()}
    assert len(by_windows) > 30 and sum(n for _, n in by_windows.values()) == 12 * 1000
