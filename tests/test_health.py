import pytest

from muster.operators import any_true, attach_severity, classify_environment, error_count, threshold_flags, verdict
from muster.plans.flows import health_report, resource_flags
from muster.plans.small import MAX_ROWS, literal_table
from muster.sources import parse_df, parse_meminfo, read_host_lines

LINES = "installation_id string, source string, pos int, line string"
RESULTS = "installation_id string, run_id string, probe string, failed boolean"


def meminfo(installation, total, available):
    return [
        (installation, "meminfo", 0, f"MemTotal:        {total} kB"),
        (installation, "meminfo", 1, "MemFree:  1 kB"),
        (installation, "meminfo", 2, f"MemAvailable:    {available} kB"),
    ]


def disk(installation, free):
    return [
        (installation, "df", 0, "Filesystem     1M-blocks  Used Available Use% Mounted on"),
        (installation, "df", 1, f"/dev/sda1          30000 20000 {free}  67% /data"),
    ]


def test_readings(spark, rows):
    lines = spark.createDataFrame(
        meminfo("a", 2047, 1024) + meminfo("b", 300000, 262143) + meminfo("c", 300000, 262144) + meminfo("d", "x", "y"), LINES
    )
    memory = parse_meminfo(lines, ["installation_id"])
    assert rows(memory) == [("a", 1, 1), ("b", 292, 255), ("c", 292, 256), ("d", None, None)]
    free = parse_df(spark.createDataFrame(disk("a", 99) + disk("b", 100) + disk("e", "-"), LINES), ["installation_id"])
    assert rows(free) == [("a", 99), ("b", 100), ("e", None)]
    flags = resource_flags(memory, free)
    assert rows(flags.filter("severity = 'error'"), "installation_id", "metric") == [
        ("a", "disk_free"),
        ("a", "memory_available"),
        ("b", "memory_available"),
    ]
    assert flags.count() == 10


def test_host_files(spark, tmp_path, rows):
    (tmp_path / "meminfo").write_text("MemTotal: 4096 kB\nMemAvailable: 2048 kB\n")
    lines = read_host_lines(spark, str(tmp_path))
    assert rows(lines, "pos", "line") == [(0, "MemTotal: 4096 kB"), (1, "MemAvailable: 2048 kB")]
    assert rows(parse_meminfo(lines, ["file"]), "memory_total", "memory_available") == [(4, 2)]


@pytest.fixture
def results(spark):
    failures = [
        ("a", "1", "memory_available"),
        ("a", "1", "dns"),
        ("a", "1", "npm_registry"),
        ("b", "1", "node"),
        ("b", "1", "npm"),
        ("b", "1", "data_writable"),
        ("b", "2", "cli_found"),
        ("c", "1", "unheard_of"),
    ]
    passes = [("a", "1", "node"), ("b", "2", "node"), ("d", "1", "dns")]
    return spark.createDataFrame(
        [(*row, True) for row in failures] + [(*row, False) for row in passes] + [("d", "1", "npm", None)], RESULTS
    )


def test_severity(results, rows):
    found = rows(attach_severity(results).filter("failed"), "installation_id", "probe", "severity", "counts_as_failure")
    assert ("a", "npm_registry", "warning", False) in found
    assert ("a", "dns", "error", False) in found
    assert ("b", "node", "error", True) in found
    assert ("c", "unheard_of", None, False) in found


def test_error_count(results, rows):
    assert rows(verdict(error_count(results))) == [
        ("a", "1", 0, "passed"),
        ("b", "1", 2, "2 check(s) failed"),
        ("b", "2", 1, "1 check(s) failed"),
        ("c", "1", 0, "passed"),
        ("d", "1", 0, "passed"),
    ]


def test_environment(spark, results, rows):
    lines = spark.createDataFrame(
        [
            ("a", "modules", 0, "vboxguest 1 0"),
            ("b", "modules", 0, "ext4 1 0"),
            ("b", "cpuinfo", 0, "model name : QEMU Virtual CPU version 2.5+"),
            ("c", "cpuinfo", 0, "vboxguest"),
            ("c", "modules", 0, None),
            ("e", "modules", 0, "vboxguest"),
            ("e", "cpuinfo", 0, "QEMU Virtual CPU"),
        ],
        LINES,
    )
    assert rows(classify_environment(lines)) == [
        ("a", True, False, "virtualbox"),
        ("b", False, True, "virtual"),
        ("c", False, False, "other"),
        ("e", True, True, "virtualbox"),
    ]
    report = rows(health_report(results, lines), "installation_id", "run_id", "errors", "environment")
    assert report == [("a", "1", 0, None), ("b", "1", 2, "virtual"), ("b", "2", 1, "virtual"), ("c", "1", 0, None), ("d", "1", 0, None)]


def test_own_rules(spark, rows):
    readings = spark.createDataFrame([("a", "t", 4.0), ("a", "u", 4.0), ("b", "t", None)], "id string, metric string, value double")
    rules = [("t", 5.0, "warning")]
    expected = [("a", "t", "warning"), ("a", "u", "info"), ("b", "t", "info")]
    assert rows(threshold_flags(readings, rules), "id", "metric", "severity") == expected
    table = spark.createDataFrame(rules, "metric string, lower_limit double, severity string")
    assert rows(threshold_flags(readings, table), "id", "metric", "severity") == expected


def test_any_true(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", True), ("b", False), ("c", None)], "id string, migrated boolean")
    assert rows(any_true(df, ["id"], "migrated")) == [("a", True), ("b", False), ("c", False)]


def test_literal_table(spark):
    assert literal_table(spark, [], "a int").count() == 0
    with pytest.raises(ValueError):
        literal_table(spark, [(1,)] * (MAX_ROWS + 1), "a int")
