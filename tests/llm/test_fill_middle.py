import hashlib
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_brute_force(spark, odd_texts):
    texts = odd_texts + ["a <P> b", "<S>", "x<M>", "<", "P> a <", "<P", " lead", "trail \n", "é x y"] * 3
    ids = [None if k % 17 == 0 else k % 60 for k in range(len(texts))]
    df = documents(spark, texts, ids).withColumnRenamed("print", "Output").withColumnRenamed("key", "form").repartition(3)
    cut = fill_middle.rearrange(df.withColumnRenamed("Output", "output"))
    back = fill_middle.restore(cut)
    rows = back.collect()
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr)
    assert got == sorted(((i, t, *brute(i, t)) for i, t in zip(ids, texts)), key=repr)
    assert all(r.restored == (r.text or "") and r.restored_sha256 == sha(r.restored) for r in rows)
    assert all(r.output_sha256 == sha(r.output) for r in rows)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


@settings(max_examples=300, deadline=None)
@given(st.text("ab <>PSM\n\té ", max_size=30), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_round_trip(text, one, two, form):
    data = text.encode()
    ends = fill_middle.token_ends(data)
    assert [data[a:b].decode() for a, b in zip([0, *ends], ends)] == UNIT.findall(text)
    low, high = sorted(int([0, *ends][k % (len(ends) + 1)]) for k in (one, two))
    if any(mark in data for mark in fill_middle.SENTINELS):
        return
    table = fill_middle.arranged(data, low, high, form)
    assert len(table.spans) <= 6
    parts = {0: data[:low], 2: data[low:high], 1: data[high:]}
    output = b"".join(fill_middle.SENTINELS[p] + parts[p] for p in fill_middle.ORDER[form])
    assert table.written() == output and table.digest() == hashlib.sha256(output).hexdigest()
    again = fill_middle.restored(output, form)
    assert again.written() == data and again.digest() == hashlib.sha256(data).hexdigest()


def test_split_keeps_the_sequence():
    rng = random.Random(3)
    table = fill_middle.Pieces(b"abcdefghij")
    for _ in range(40):
        place = rng.randint(0, 12)
        before = table.split(place)
        assert table.written() == b"abcdefghij"
        assert b"".join(list(table.views())[:before]) == b"abcdefghij"[:place]


def test_rates_and_seed(spark):
    df = documents(spark, [f"one two three four {k}" for k in range(400)])
    forms = [r.form for r in fill_middle.rearrange(df, rate=100, suffix_first=0).collect()]
    assert set(forms) == {"psm"}
    assert {r.form for r in fill_middle.rearrange(df, rate=0).collect()} == {"plain"}
    one, two = (sorted(r.output for r in fill_middle.rearrange(df, seed=s).collect()) for s in (1, 2))
    assert one != two


def test_output_without_sentinels_stays():
    assert fill_middle.restored(b"no marks", "psm").written() == b"no marks"
    assert fill_middle.restored(b"<P>a", None).written() == b"<P>a"


def test_empty_table(spark):
    df = fill_middle.restore(fill_middle.rearrange(documents(spark, [])))
    assert df.count() == 0 and df.columns[-2:] == ["restored", "restored_sha256"]


def test_texts_are_taken_by_bytes(spark, monkeypatch):
    """A batch of long texts is worked on, and handed on, some megabytes at a time."""
    runs = []
    monkeypatch.setattr(fill_middle, "map_arrow", lambda df, run, schema: runs.append(run) or df)
    fill_middle.rearrange(documents(spark, ["a"]).select("doc_id", "text"))
    fill_middle.restore(spark.createDataFrame([("a", "plain")], "output string, form string"))
    texts = ["word " * 200_000, None, "é b", "x " * 3_000_000] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts})
    cut = list(runs[0](iter([batch])))
    assert [i for some in cut for i in some["doc_id"].to_pylist()] == list(range(20))
    assert [row for some in cut for row in some["output"].to_pylist()] == [brute(i, text)[-1] for i, text in enumerate(texts)]
    assert max(sum(len(t or "") for t in some["text"].to_pylist()) for some in cut) <= 6_000_000
    whole = pa.RecordBatch.from_pydict({"output": texts, "form": ["plain"] * 20})
    back = list(runs[1](iter([whole])))
    assert len(back) > 5 and [row for some in back for row in some["restored"].to_pylist()] == [text or "" for text in texts]
