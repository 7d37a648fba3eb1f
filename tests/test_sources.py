from datetime import datetime

import pytest

from muster.operators import package_line, package_rows
from muster.plans.flows import startup_packages
from muster.schemas import STATE_KEYS
from muster.sources import (
    corrupt_documents,
    latest_version,
    read_log_lines,
    read_options,
    read_package_state,
    read_package_versions,
    read_version,
    write_package_state,
    write_version,
)
from muster.sources.versions import version_path

STATE = "installation_id string, kind string, package string"


def test_documents_from_files(spark, tmp_path, rows):
    for installation, options, state in [
        ("a", '{"launch": false, "persistent_apk_packages": ["vim"]}', '{\n  "apk_packages": ["jq"],\n  "pip_packages": []\n}'),
        ("b", "launch: false", '{"pip_packages": ["x"]}'),
    ]:
        for kind, text in [("options", options), ("state", state)]:
            folder = tmp_path / kind / f"installation_id={installation}"
            folder.mkdir(parents=True)
            (folder / "document.json").write_text(text)
    options = read_options(spark, str(tmp_path / "options"), "launch")
    state = read_package_state(spark, str(tmp_path / "state"))
    assert rows(options, "installation_id", "auto_launch") == [("a", False), ("b", True)]
    assert rows(startup_packages(options, state)) == [("a", "apk", "jq vim"), ("b", "pip", "x")]


def test_documents_from_lines(spark, tmp_path, rows):
    folder = tmp_path / "installation_id=a"
    folder.mkdir()
    (folder / "documents.txt").write_text('{"apk_packages": ["vim"]}\n{"apk_packages": [}\n{"pip_packages": ["x", null]}\n')
    state = read_package_state(spark, str(tmp_path), per_line=True)
    assert state.count() == 3 and corrupt_documents(state).count() == 1
    assert rows(package_line(package_rows(state, STATE_KEYS))) == [("a", "apk", "vim"), ("a", "pip", "x")]


def test_versions(spark, tmp_path, rows):
    path = str(tmp_path / "state")
    assert latest_version(spark, path) is None and rows(read_package_versions(spark, path)) == []
    first = spark.createDataFrame([("a", "apk", "vim")], STATE)
    write_package_state(first, path, 1)
    second = read_package_versions(spark, path).select("installation_id", "kind", "package").unionByName(
        spark.createDataFrame([("a", "pip", "x")], STATE)
    )
    write_package_state(second, path, 2)
    assert rows(read_package_versions(spark, path), "kind", "package") == [("apk", "vim"), ("pip", "x")]
    assert rows(read_package_versions(spark, path, 1), "kind", "package") == [("apk", "vim")]
    with pytest.raises(Exception, match="already exists"):
        write_package_state(second, path, 2)


def test_unfinished_version_does_not_count(spark, tmp_path):
    path = str(tmp_path / "table")
    write_version(spark.range(3), path, 1)
    spark.range(9).write.parquet(version_path(path, 2))
    (tmp_path / "table" / "version=2" / "_SUCCESS").unlink()
    assert latest_version(spark, path) == 1
    assert read_version(spark, path).count() == 3
    write_version(spark.range(4), path, 2)
    assert latest_version(spark, path) == 2 and read_version(spark, path).count() == 4
    write_version(spark.range(5), path, 10)
    assert latest_version(spark, path) == 10
    with pytest.raises(FileExistsError):
        write_version(spark.range(5), path, 2)
    with pytest.raises(FileNotFoundError):
        read_version(spark, str(tmp_path / "nowhere"))


def test_versions_with_other_keys_and_positions(spark, tmp_path, rows):
    path, columns = str(tmp_path / "state"), "site BIGINT, package STRING, pos INT"
    write_package_state(spark.createDataFrame([(7, "apk", "vim", 0)], "site bigint, kind string, package string, pos int"), path, 1)
    found = read_package_versions(spark, path, columns=columns)
    assert rows(found, "site", "kind", "package", "pos") == [(7, "apk", "vim", 0)]
    assert found.schema["site"].dataType.typeName() == "long"


def test_paths_that_are_not_there(spark, tmp_path, rows):
    missing = str(tmp_path / "nowhere")
    state = read_package_state(spark, missing, keys="site BIGINT")
    assert rows(state) == [] and state.columns == ["site", "apk_packages", "pip_packages", "_corrupt_record"]
    options = read_options(spark, missing, "launch")
    assert rows(options) == [] and options.columns[:2] == ["installation_id", "auto_launch"]


def test_directory_keys_have_declared_types(spark, tmp_path, rows):
    folder = tmp_path / "site=007"
    folder.mkdir()
    (folder / "document.json").write_text('{"apk_packages": ["jq"]}')
    assert rows(read_package_state(spark, str(tmp_path), keys="site STRING"), "site") in ([("007",)], [("7",)])
    assert rows(read_package_state(spark, str(tmp_path), keys="site BIGINT"), "site") == [(7,)]


def test_log_lines(spark, tmp_path, rows):
    folder = tmp_path / "installation_id=a"
    folder.mkdir()
    (folder / "log.txt").write_text("[2024-01-01 00:00:01] INFO: started\n2024-01-01T00:00:02 ERROR broken\nfree text\n")
    assert rows(read_log_lines(spark, str(tmp_path))) == [
        ("a", None, None, "free text"),
        ("a", datetime(2024, 1, 1, 0, 0, 1), "info", "started"),
        ("a", datetime(2024, 1, 1, 0, 0, 2), "error", "broken"),
    ]
