import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import simhash
from muster.llm.components import components


def brute_print(text, words=4):
    parts = [w for w in re_split(text or "")]
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def re_split(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute_roots(prints, ids, radius):
    root = list(range(len(prints)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[top(a)] = top(b)
    members = {}
    for k in range(len(prints)):
        members.setdefault(top(k), []).append(ids[k])
    smallest = {k: min((i for i in some if i is not None), default=None) for k, some in members.items()}
    return [smallest[top(k)] for k in range(len(prints))]


def near_copies(rng, n):
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(words))
    return texts


def check(spark, texts, ids, **more):
    prints = [brute_print(text) for text in texts]
    expected = zip(ids, (f"{p:016x}" for p in prints), brute_roots(prints, ids, simhash.RADIUS))
    rows = simhash.near_duplicates(documents(spark, texts, ids).repartition(4), **more).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))


def test_against_brute_force(spark, odd_texts):
    texts = odd_texts + near_copies(random.Random(5), 150)
    check(spark, texts, list(range(100, 100 + len(texts))))


def test_repeated_and_missing_ids(spark):
    texts = near_copies(random.Random(6), 30) + [None, "", " "]
    check(spark, texts, [None if k % 4 == 0 else k % 9 for k in range(len(texts))])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def linked(df):
    pairs = [(row.u, row.v) for row in df.collect()]
    nodes = sorted({n for pair in pairs for n in pair})
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_large_shards_are_cut_without_loss(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(300)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    whole, cut = linked(simhash.near_links(df)), linked(simhash.near_links(df, limit=40))
    assert whole == cut
    expected = brute_roots([p & (1 << 64) - 1 for p in signed], signed, 4)
    assert {n: r for n, r in zip(signed, expected) if r != n or n in whole} == whole


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**12), min_size=1, max_size=80), st.integers(0, 3))
def test_tree_finds_all_within_the_radius(prints, radius):
    items = np.array(sorted(prints), np.uint64)
    groups = (items % np.uint64(3)).astype(np.int64)
    tree = simhash.build_forest(groups, items)
    first = tree[0][np.unique(groups, return_inverse=True)[1]]
    found = {
        (int(a), int(b))
        for who, node in simhash.search_forest(tree, items, items, first, radius)
        for a, b in zip(who, node)
    }
    assert found == {
        (a, b)
        for a in range(len(items))
        for b in range(len(items))
        if groups[a] == groups[b] and (int(items[a]) ^ int(items[b])).bit_count() <= radius
    }


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)]
    links += [(5, 5), (900, 900), (None, 3), (7, None)] + [(2000, 2001 + k) for k in range(200)]
    df = spark.createDataFrame(links, "u long, v long")
    found = {row.node: row.root for row in components(df).collect()}
    clean = [link for link in links if None not in link]
    expected = linked(spark.createDataFrame(clean, "u long, v long"))
    assert found == expected
    assert components(df.limit(0)).count() == 0
