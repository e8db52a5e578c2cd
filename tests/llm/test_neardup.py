import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import neardup, queries
from tidemark.llm.components import connected_components
from tidemark.llm.shared import Workspace

UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sets_of(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(UPPER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n, component) of rows; rows of an id are one node."""
    sets, held = [sets_of(t) for _, t in rows], defaultdict(list)
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            held[g].append(k)
    for k, (i, _) in enumerate(rows):
        if i is None:
            continue
        common = Counter(j for g in sets[k] for j in held[g] if j < k and rows[j][0] is not None)
        for j, c in common.items():
            if 100 * c >= 75 * (len(sets[k]) + len(sets[j]) - c):
                a, b = top(i), top(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else top(i) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def run(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()), key=str)


def family(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(1000))
    return " ".join(words)


def test_odd_rows(make_docs, odd_rows):
    got = neardup.near_duplicates(make_docs(odd_rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(odd_rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_families_against_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(11)
    rows = []
    for f in range(12):
        base = " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice((6, 12, 60, 150))))
        rows += [(100 * f + k, family(rng, base, k % 9)) for k in range(40)]
    rng.shuffle(rows)
    assert run(make_docs(rows)) == brute(rows)


def test_one_id_with_two_texts(make_docs):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (7, b), (7, a + " more"), (9, b + " end")]
    assert {r[2] for r in run(make_docs(rows))} == {1}


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def test_sketch_finds_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        shared, a, b = (np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (300, 50, 50))
        x, y = np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))
        keys = neardup._sketch(np.concatenate([x, y]), np.array([0, 350, 700]))[:, :]
        same = keys[0] == keys[1]
        missed += not (same[: neardup.HALVES].any() and same[neardup.HALVES :].any())
    assert missed == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (901, 900)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Workspace(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op5_tensored_minhash(spark, sf).collect()), key=str) == brute(rows)


def test_exact_rest_compares_whole_hashes():
    """Two sets at 0.75 and one below, of 64-bit values whose halves coincide often."""
    value = lambda i: ((i // 64) << 32) | (i % 64)
    sets = [range(350), [*range(300), *range(1000, 1050)], [*range(299), *range(2000, 2051)]]
    items = [np.array([value(i) for i in s], np.uint64).tobytes() for s in sets]
    same = [0, 0, 0]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (same, same, same, [1, 2, 3], [1, 2, 3], same, [350, 350, 350])] + [pa.array(items, pa.binary())], names=["half", "lo", "hi", "node", "part", "side", "n", "items"]
    )
    assert [(r["a"], r["b"]) for out in neardup._across(75)(iter([batch])) for r in out.to_pylist()] == [(1, 2)]
