import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import binpack, queries


def checked(rows, got, shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(make_docs, odd_rows):
    checked(odd_rows, binpack.pack(make_docs(odd_rows), 3).collect(), 3)


def test_hot_group_is_split_and_light_groups_are_not(make_docs, monkeypatch):
    monkeypatch.setattr(binpack, "SLOT_ROWS", 20)
    rows = [(k, "the same text again") for k in range(1000)] + [(1000 + k, f"text number {k // 2}") for k in range(2000)]
    got = binpack.pack(make_docs(rows), 8).collect()
    checked(rows, got, 8)
    sizes, counts = Counter(), Counter()
    where = defaultdict(set)
    texts = dict(rows)
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
        where[texts[r["doc_id"]]].add(r["shard"])
    assert max(sizes.values()) < 1.05 * min(sizes.values()) and max(counts.values()) < 1.05 * min(counts.values())
    assert len(where["the same text again"]) > 2
    assert all(len(s) == 1 for t, s in where.items() if t != "the same text again")


def brute(rows, shards):
    """Rows of each text in each shard: one level, one cell, placed one after another."""
    groups = defaultdict(list)
    for _, t in rows:
        groups[t or ""].append(t or "")
    vector = lambda t, n: np.array([n * (len(t.encode()) + 16), n * len(t.split()), n], float)
    totals = np.maximum(sum((vector(t, len(m)) for t, m in groups.items()), np.zeros(3)), 1)
    units = []
    for t, m in groups.items():
        quarters = max(vector(t, len(m)) * (shards * binpack.HEAVY_PART / totals))
        pieces = int(np.ceil(quarters * 16)) if quarters > 1 else 1
        cuts = [-(-i * len(m) // pieces) for i in range(pieces + 1)]
        units += [(t, i if pieces > 1 else -1, vector(t, cuts[i + 1] - cuts[i]) / totals, cuts[i + 1] - cuts[i]) for i in range(pieces)]
    units.sort(key=lambda u: (-max(u[2]), zlib.crc32(u[0].encode()), len(u[0].encode()), u[1]))
    left, out = np.full((shards, 3), 1 / shards) * sum(u[2] for u in units), defaultdict(Counter)
    for t, _, size, n in units:
        best = int((left @ size).argmax())
        left[best] -= size
        out[t][best] += n
    return out


def spread(rows, got):
    texts = {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): t or "" for _, t in rows}
    out = defaultdict(Counter)
    for r in got:
        out[texts[r["size"], r["text_crc32"]]][r["shard"]] += 1
    return out


@pytest.mark.parametrize("ids", [lambda k: k, lambda k: None, lambda k: 7])
def test_against_brute_force(make_docs, ids):
    rng = random.Random(3)
    rows = [(ids(k), "one text that many rows hold") for k in range(300)] + [(ids(k), " ".join("ab" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40)))) for k in range(400)]
    rows += rows[:100] + [(ids(k), None) for k in range(20)]
    got = binpack.pack(make_docs(rows), 7).collect()
    checked(rows, got, 7)
    assert spread(rows, got) == brute(rows, 7)


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: k // 1000])
def test_law_holds_for_a_hot_text_of_null_or_repeated_ids(make_docs, ids):
    rows = [(ids(k), "x" * 200) for k in range(4000)] + [(ids(k), f"small {k}") for k in range(4000)]
    got = binpack.pack(make_docs(rows), 40).collect()
    checked(rows, got, 40)
    sizes, counts = Counter(), Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert max(sizes.values()) < 1.02 * min(sizes.values()) and max(counts.values()) < 1.02 * min(counts.values())


def test_levels_and_cells(make_docs, monkeypatch):
    """Many small cells keep the law, groups stay whole, and a level above takes what is large for a cell."""
    monkeypatch.setattr(binpack, "CELL_GROUPS", 100)
    monkeypatch.setattr(binpack, "CELL_FACTOR", 4)
    assert binpack.levels(2500) == [1, 4, 16, 25]
    rng = random.Random(5)
    rows = [(k, f"{k // 2} " + "word " * min(300, int(rng.paretovariate(1.1)))) for k in range(4000)]
    got = binpack.pack(make_docs(rows), 5).collect()
    checked(rows, got, 5)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_place_takes_the_highest_dot_product():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, (60, 3)).astype(float)
    sizes /= sizes.sum(axis=0)
    got = binpack.place(sizes, np.full((4, 3), 0.25), np.arange(60), 1)
    left = np.full((4, 3), 0.25)
    assert got[0] == 1
    for k in range(60):
        products = [float(left[s] @ sizes[k]) for s in range(4)]
        assert products[got[k]] >= max(products) - 1e-12
        left[got[k]] -= sizes[k]


def test_empty_table(make_docs):
    assert binpack.pack(make_docs([]), 5).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_vector_bin_packing(spark, sf).collect()
    checked(rows, got, 40)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 40 and max(sizes.values()) < 1.02 * min(sizes.values())
