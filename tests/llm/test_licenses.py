import re

import pytest
from llm.conftest import documents
from muster.llm import licenses


def found(spark, texts, ids=None):
    rows = licenses.scan(documents(spark, texts, ids)).collect()
    return sorted((r.doc_id, r.scope, r.place, r.license) for r in rows)


def test_known_texts_have_a_hint():
    assert all(re.search(licenses.HINT, text) for _, text in licenses.known_texts())


def test_variants(spark):
    mit = licenses.FULL_TEXTS["MIT"]
    wrapped = "/*\n * Copyright (c) 2020 Jane Doe\n" + "\n".join(" * " + line for line in re.findall(r".{1,60}(?:\s|$)", mit.split("\n\n", 1)[1].replace("\n", " "))) + "\n */"
    texts = [
        mit,
        mit.upper().replace("SUBLICENSE", "sub-licence"),
        "MIT Licence\n\nCopyright © 2019 me\nAll rights reserved.\n\n" + mit.split("\n\n", 1)[1],
        wrapped,
        mit + " And more.",
        "intro\n\n" + wrapped + "\n\nend",
        "one\nReleased under the MIT Licence.\nthree\nlicensed under cc by-nc 4.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "I licensed my car.",
        "SPDX-License-Identifier: Apache-2.0",
    ]
    assert found(spark, texts) == [
        (0, "document", 0, "MIT"),
        (1, "document", 0, "MIT"),
        (2, "document", 0, "MIT"),
        (3, "document", 0, "MIT"),
        (5, "block", 1, "MIT"),
        (6, "line", 1, "MIT"),
        (6, "line", 3, "CC-BY-NC-4.0"),
        (7, "document", 0, "GPL-3.0"),
        (9, "document", 0, "Apache-2.0"),
    ]


def commented(text, mark):
    """A source file with the text as its head comment."""
    lines = ["Copyright (C) 2021 Jane Doe", "", *text.split("\n")]
    return "\n".join(f"{mark} {line}".rstrip() for line in lines) + "\n\ndef main():\n    pass\n"


def longer_texts():
    return [(name, text) for name, text in licenses.known_texts() if len(text) > 150]


def test_every_known_text_in_a_readme(spark):
    """In its own paragraphs, with a heading and other text around it, and as one paragraph per sentence group."""
    known = longer_texts()
    texts = [f"# Project\n\nDoes things.\n\n## License\n\nCopyright (c) 2020 Jane Doe\n\n{text}\n\n## Contact\n\nWrite to us." for _, text in known]
    rows = found(spark, texts)
    # A notice of one paragraph on one line is a line.
    by_text = {i: {(scope, name) for j, scope, _, name in rows if j == i} for i in range(len(texts))}
    wrong = [name for i, (name, text) in enumerate(known) if ("blocks" if "\n\n" in text else "line", name) not in by_text[i]]
    assert not wrong
    assert {name for name, _ in known} >= {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "Apache-2.0",
                                           "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0"}


def test_every_known_text_in_a_source_comment(spark):
    known = longer_texts()
    for mark in ("#", " *"):
        rows = found(spark, [commented(text, mark) for _, text in known])
        hits = {(i, name) for i, scope, _, name in rows if scope == "block"}
        assert {(i, name) for i, (name, _) in enumerate(known)} <= hits


def test_runs(spark):
    """However paragraphs are divided; of nested runs the longest; not within a document that is a licence."""
    bsd, mit = licenses.FULL_TEXTS["BSD-3-Clause"], licenses.FULL_TEXTS["MIT"]
    gpl = next(text for text in licenses.gnu_notices("General", "3") if "along with this program. If not, see" in text)
    texts = [
        bsd,
        "intro\n\n" + bsd.replace("\n\n2.", "\n2.").replace("IN NO EVENT", "\n\nIN NO EVENT") + "\n\nend",
        gpl + "\n\nend",
        mit + "\n\nend",
        "intro\n\n" + mit.split("\n\n", 1)[1].replace("AS IS", "AS WAS"),
        "a\n\n" + mit + "\n\nb\n\n" + bsd,
    ]
    assert [row for row in found(spark, texts) if row[1] in ("document", "blocks")] == [
        (0, "document", 0, "BSD-3-Clause"), (1, "blocks", 1, "BSD-3-Clause"), (2, "blocks", 0, "GPL-3.0"), (3, "blocks", 0, "MIT"),
        (5, "blocks", 1, "MIT"), (5, "blocks", 6, "BSD-3-Clause"),
    ]


def test_odd_rows(spark, odd_texts):
    assert found(spark, odd_texts) == []
    notice = "Released under the MIT License."
    assert found(spark, [notice, notice, None], [4, 4, None]) == [(4, "document", 0, "MIT")] * 2
    assert found(spark, ["x " * 50_000 + "\n" + notice]) == [(0, "line", 1, "MIT")]
    assert found(spark, []) == []
    df = documents(spark, [notice], [None]).selectExpr("*", "1 AS digest", "2 AS license", "3 AS scope", "4 AS place")
    assert licenses.scan(df).collect()[0].license == "MIT"


def test_plan_is_native(spark):
    plan = licenses.scan(documents(spark, ["license"]))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas", plan)


def test_runs_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    known = longer_texts()
    texts = [f"intro\n\n{text}\n\nend" for _, text in known[::3]] + [text for _, text in known[::5]]
    texts += [f"{a}\n\n{b}" for (_, a), (_, b) in zip(known[::4], known[1::4])]
    df = documents(spark, texts, [k % 50 for k in range(len(texts))]).select("doc_id", "text")
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    expected = sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert sorted(map(tuple, licenses.scan(df).collect())) == expected and any(row[1] == "blocks" for row in expected)


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_against_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    path = f"/root/testdata/{folder}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    expected = sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert sorted(map(tuple, licenses.scan(spark.read.parquet(path)).collect())) == expected and expected
