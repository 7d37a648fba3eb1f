import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return pieces.vocabulary(file.read())


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return pieces.Encoder(vocabulary)


@pytest.fixture(scope="module")
def decoder(vocabulary):
    return pieces.Decoder(vocabulary)


def odd(rng):
    """A text with runs of white space, pieces next to each other, unknown and rare characters."""
    stock = [" ", "  ", " " * 5, " " * 16, " " * 17, " " * 33, "\n", "\t", "▁", "▁▁", "the", "ing", "aaaa", "ab", "é", "中文", "😀", "\x00", "=", "==", "\r\n", "1", "2024", "ffi", "é", "</s>", "<0x0A>", "<unk>"]
    return "".join(rng.choice(stock) if rng.random() < 0.6 else chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1500), rng.randint(0x4E00, 0x9FFF)])) for _ in range(rng.randint(0, 40)))


def test_odd_texts(library, encoder, decoder):
    rng = random.Random(11)
    texts = [odd(rng) for _ in range(4000)] + [" " * k + tail for k in range(70) for tail in ("", "the", "x", "\n", "中")]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text), repr(text)
        assert decoder.decode(ids) == library.decode(ids), repr(text)


def test_runs_of_pieces(library, encoder):
    rng = random.Random(5)
    normal = [piece.replace("▁", " ") for piece, kind in zip(encoder.known.pieces, encoder.known.kinds) if kind == pieces.NORMAL]
    for _ in range(3000):
        text = "".join(rng.choices(normal, k=rng.randint(1, 12)))
        assert encoder.encode(text) == library.encode(text), repr(text)


def test_compatible_pairs_by_merging(encoder):
    """Taking merges back gives what merging the joined text gives, for likely and for random neighbours."""
    rng = random.Random(6)
    plain = [k for k, yes in enumerate(encoder.known.plain) if yes and encoder.known.kinds[k] == pieces.NORMAL]
    pairs = [tuple(rng.choices(plain, k=2)) for _ in range(4000)]
    for piece in rng.choices(plain, k=4000):
        text = encoder.known.pieces[piece]
        for cut in range(1, len(text)):
            if text[:cut] in encoder.ids and text[cut:] in encoder.ids:
                pairs.append((encoder.ids[text[:cut]], encoder.ids[text[cut:]]))
    plain = set(plain)
    for left, right in pairs:
        if left in plain and right in plain:
            assert encoder.unjoined(left, right) == encoder.remerged(left, right)


def test_one_last_piece(encoder):
    """Of all pieces that end at a place, one alone is compatible with the prefix before it."""
    rng = random.Random(8)
    for _ in range(200):
        text = "▁" + "".join(rng.choices("aehinorst", k=40))
        last = encoder.table(text)
        for end, piece in encoder.automaton.iter(text):
            before = end - encoder.lengths[piece]
            fits = before < 0 or encoder.compatible(last[before], piece)
            assert fits == (piece == last[end])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decode_any_ids(library, decoder, ids):
    assert decoder.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 198, 199, 231, 35, 130, 230, 28705, 259, 272]), max_size=9))
def test_decode_odd_ids(library, decoder, ids):
    assert decoder.decode(ids) == library.decode(ids)


def test_long_part_is_linear(library, encoder):
    text = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    assert encoder.encode(text) == library.encode(text)


def test_long_text(library, encoder, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 10)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    text = "one two three\nfour  five six seven one two"
    assert encoder.encode(text) == library.encode(text)


def test_tables(spark, library, odd_texts):
    texts = odd_texts + [odd(random.Random(k)) for k in range(30)] + [None]
    df = documents(spark, texts, [k % 9 for k in range(len(texts))]).withColumnRenamed("print", "Decoded").withColumnRenamed("key", "ids")
    back = pieces.decode(pieces.encode(df.repartition(3), PATH), PATH)
    got = sorted(((r.doc_id, r.text, r.ids, r.decoded) for r in back.collect()), key=repr)
    ids = [library.encode(text or "") for text in texts]
    assert got == sorted(((k % 9, t, i, library.decode(i)) for k, (t, i) in enumerate(zip(texts, ids))), key=repr)
    none = pieces.decode(spark.createDataFrame([(None,), ([],), ([None, 272],)], "ids array<int>"), PATH)
    assert sorted(r.decoded for r in none.collect()) == ["", "", library.decode([272])]
    assert pieces.decode(pieces.encode(documents(spark, []), PATH), PATH).count() == 0


def test_given_documents(spark, library):
    import hashlib

    from muster.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op11_sentencepiece"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids, got = library.encode(row.text or ""), rows.pop(row.doc_id)
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not rows
