import itertools
import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from tidemark.llm import decontam, queries

BENCH = "item_id long, text string, doc_id long"


def tokens(text):
    out, word = [], ""
    for ch in text or "":
        han = "\u3040" <= ch <= "\u30ff" or "\u4000" <= ch <= "\u9fff"
        if han or not (ch > "\x7f" or ch.isalnum()):
            out += [word] if word else []
            word = ""
            out += [ch] if han else []
        else:
            word += ch.lower() if ch < "\x80" else ch
    return [*out, word] if word else out


def brute(docs, items):
    found = set()
    for d, t in docs:
        words = tokens(t)
        for i, b in items:
            target = tokens(b)
            n = min(len(target), decontam.WINDOW)
            if len(target) < decontam.SEED_WORDS:
                if target and words == target:
                    found.add((d, i))
                continue
            for shift in range(-len(words), len(target)):
                agree = [words[p] == target[p + shift] for p in range(max(0, -shift), min(len(words), len(target) - shift))]
                if any(sum(agree[k : k + n]) >= decontam.needed(len(target)) for k in range(len(agree) - n + 1)):
                    found.add((d, i))
                    break
    return found


def test_masks_hit_every_pattern():
    for length, wrong in ((15, 3), (14, 2), (13, 2), (12, 2), (11, 2), (10, 2), (9, 1), (8, 1), (7, 0), (6, 0), (5, 0)):
        for bad in itertools.combinations(range(length), wrong):
            assert any(all(p + o not in bad for o in m) for m in decontam.MASKS for p in range(length - m[-1])), (length, bad)


def test_against_brute_force(spark, make_docs):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of"] * 8
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 7, 8, 10, 14, 15, 30))))) for k in range(20)] + [(20, None), (21, ""), (22, "one item")]
    docs = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        item = rng.choice(items[:20])[1].split()
        for _ in range(rng.randrange(0, 5)):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        at = rng.randrange(len(words) + 1)
        docs.append((k, " ".join(words[:at] + (item if k % 2 else []) + words[at:])))
    docs += [(200, "One, item!"), (201, "one item more"), (202, "one")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(make_docs(docs), bench).collect()}
    assert got == brute(docs, items) and (200, 22) in got and len({d for d, i in got if i == 22}) == 1
    clean = {r["doc_id"] for r in decontam.decontaminate(make_docs(docs), bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def slices(texts):
    _, data, offsets = next(decontam.text_slices(pa.array(texts), 1 << 62))
    return decontam.words(data, offsets, decontam.NON_ALNUM, True)[:2]


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 19), (7, 40)])
def test_repetitive_texts_against_brute_force(monkeypatch, limits):
    """Runs, periods and few words, where seeds hit nearly everywhere; with small blocks too."""
    monkeypatch.setattr(decontam, "HITS", limits[0])
    monkeypatch.setattr(decontam, "COMPARED", limits[1])
    rng = random.Random(8)
    some = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    items = [(0, "a " * 30), (1, "a b " * 12), (2, some(25, "ab")), (3, some(16, "abc")), (4, "a " * 6), (5, some(20, "abcdefgh"))]
    texts = ["a " * 90, "a b " * 40, some(80, "ab"), "x " + "a " * 11 + "b " * 20, some(60, "abc"), "", "a " * 14, "b a " * 9 + some(30, "abc"), some(90, "abcdefgh") + " " + items[5][1], "b"]
    index = decontam.Index(items)
    hashes, first = slices(texts)
    got = decontam.passages(index, hashes, first)
    want = brute(list(enumerate(texts)), items)
    assert {(r, i) for r, i, *_ in got.tolist()} == want and len(got) == len(want)
    assert set(decontam.passages(index, hashes, first, True)[:, 0].tolist()) == {r for r, _ in want}
    for r, i, agree, lo, hi in got.tolist():
        assert first[r] <= lo <= hi < first[r + 1] and agree >= decontam.needed(len(items[i][1].split()))


def test_a_long_repetitive_text_is_cheap():
    hashes, first = slices(["the " * 20000])
    for n in (40, 400):
        index = decontam.Index([(1, "the " * n)])
        tracemalloc.start()
        began = time.perf_counter()
        (found,) = decontam.passages(index, hashes, first).tolist()
        assert found[:3] == [0, 0, n] and tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
        assert time.perf_counter() - began < 5


def test_scripts_without_spaces(spark, make_docs):
    passage = "今日は良い天気ですから公園へ散歩に行きましょう"
    bench = spark.createDataFrame([(3, passage, 0)], BENCH)
    docs = [(1, f"前置きの文。{passage}そして帰る。"), (2, "今日は雨"), (3, "東京と京都と大阪と名古屋と札幌と福岡と仙台")]
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminations(make_docs(docs), bench).collect()] == [(1, 3)] and brute(docs, [(3, passage)]) == {(1, 3)}


def test_odd_rows_and_passes(spark, make_docs, odd_rows, monkeypatch):
    bench = spark.createDataFrame([(1, odd_rows[3][1], 0), (2, odd_rows[10][1], 0), (None, odd_rows[3][1], 0), (1, odd_rows[3][1], 0)], BENCH)
    want = decontam.contaminations(make_docs(odd_rows), bench).collect()
    assert {r["doc_id"] for r in want if r["item_id"] == 1} >= {4, 5, None}
    assert len([r for r in want if r["doc_id"] == 4 and r["item_id"] == 1]) == 2
    monkeypatch.setattr(decontam, "PASS_WORDS", 50)
    assert sorted(want, key=str) == sorted(decontam.contaminations(make_docs(odd_rows), bench).collect(), key=str)


def test_empty_tables(spark, make_docs, odd_rows):
    empty = spark.createDataFrame([], BENCH)
    assert decontam.contaminations(make_docs(odd_rows), empty).collect() == []
    assert decontam.decontaminate(make_docs(odd_rows), empty).count() == len(odd_rows)
    assert decontam.contaminations(make_docs([]), empty).collect() == []


def test_spans_are_bytes_of_the_text(spark, make_docs):
    passage = "Ein schönes Beispiel, das niemand sonst genau so schreiben würde, nicht wahr, oder doch?"
    text = f"Vorweg é steht etwas. {passage} Danach auch."
    bench = spark.createDataFrame([(3, passage, 0)], BENCH)
    (hit,) = decontam.contaminations(make_docs([(1, "x"), (2, text)]), bench).collect()
    assert text.encode()[hit["first_byte"] :].startswith(b"Ein") and text.encode()[hit["last_word_byte"] :].startswith(b"doch")


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    short = [d for d in docs if len(d[1] or "") < 1500][:60]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_spaced_seed_decontamination(spark, sf).collect()}
    assert {p for p in got if p[0] in {d for d, _ in short}} == brute(short, items)
