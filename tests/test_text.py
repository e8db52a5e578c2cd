import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.db import Db
from tidemark.model import Catalog, entity_table
from tidemark.operators.text import B, K1, TextIndex, facts, index, parse_text, postings_of, search, search_texts
from tidemark.sources.stores import TableStore


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bm25(texts, leaves):
    """{key: score} by loops; a leaf is (function of the words to {term: count}, boost)."""
    held = {k: words(t) for k, t in texts.items() if words(t)}
    n, mean = len(held), sum(map(len, held.values())) / max(len(held), 1)
    df = Counter(w for ws in held.values() for w in set(ws))
    idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
    out = defaultdict(float)
    for find, boost in leaves:
        for k, ws in held.items():
            for term, tf in find(ws).items():
                weight = sum(idf(w) for w in term) if isinstance(term, tuple) else idf(term)
                out[k] += boost * weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
    return dict(out)


def phrase(*ws):
    return lambda held: {ws: c} if (c := sum(tuple(held[i : i + len(ws)]) == ws for i in range(len(held)))) else {}


def some(test):
    return lambda held: Counter(w for w in held if test(w))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocabulary = ["new", "york", "city", "old", "yorker", "town", "the", "of"]
    return {str(k): " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for k in range(60)} | {"a": "New-York, new York!", "b": "york new", "c": ":keyword", "d": ":not a keyword", "e": "..."}


@pytest.fixture(scope="module")
def catalog(spark, texts):
    return Catalog().add(entity_table("t", spark.createDataFrame(list(texts.items()), "id string, body string"), "id"))


CASES = [
    ('"new york"', [(phrase("new", "york"), 1)], None),
    ('"new york city"^3 OR town', [(phrase("new", "york", "city"), 3), (some(lambda w: w == "town"), 1)], None),
    ("york*", [(some(lambda w: w.startswith("york")), 1)], None),
    ("y?rk OR *ity", [(some(lambda w: w == "york"), 1), (some(lambda w: w.endswith("ity")), 1)], None),
    ("tawn~1", [(some(lambda w: w in ("town",)), 1)], None),
    ("[new TO of]", [(some(lambda w: "new" <= w <= "of"), 1)], None),
    ("{new TO *]", [(some(lambda w: w > "new"), 1)], None),
    ("+york -new", [(some(lambda w: w == "york"), 1)], lambda w: "york" in w and "new" not in w),
    ("+york new^2", [(some(lambda w: w == "york"), 1), (some(lambda w: w == "new"), 2)], lambda w: "york" in w),
    ("(old OR town)^2 AND NOT the", [(some(lambda w: w in ("old",)), 2), (some(lambda w: w == "town"), 2)], lambda w: {"old", "town"} & set(w) and "the" not in w),
    ('body:"york new"', [(phrase("york", "new"), 1)], None),
    ("keyword", [(some(lambda w: w == "keyword"), 1)], None),
]


@pytest.mark.parametrize(("query", "leaves", "keep"), CASES, ids=[c[0] for c in CASES])
def test_scores_against_brute_force(catalog, texts, query, leaves, keep):
    held = {k: t for k, t in texts.items() if k != "c"}
    want = {k: s for k, s in bm25(held, leaves).items() if keep is None or keep(words(held[k]))}
    got = {r["e"]: r["score"] for r in search(index(catalog, "body"), query, ["e"]).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_slop(catalog, texts):
    got = {r["e"] for r in search(index(catalog, "body"), '"new city"~2', ["e"]).collect()}
    near = lambda ws: any(ws[i] == "new" and "city" in ws[i + 1 : i + 4] for i in range(len(ws)))
    assert got == {k for k, t in texts.items() if near(words(t))}


def test_grammar():
    assert parse_text('"a b"~3^2')[1][0].words == ("a", "b") and parse_text('f:"a b"')[1][0].field == "f"
    assert parse_text("a -b")[0] == "and" and parse_text("a b")[0] == "or" and parse_text('"a"')[1][0].text == "a"


def test_stored_index_updates_evicts_and_pages(spark, catalog, texts, tmp_path):
    stored = TextIndex(spark, f"file://{tmp_path}/ix").build(catalog, "body")
    now = {k: t for k, t in texts.items() if k != "c"}
    score = lambda: {r["e"]: round(r["score"], 9) for r in stored.search("york OR city").collect()}
    want = lambda: {k: round(s, 9) for k, s in bm25(now, [(some(lambda w: w in ("york", "city")), 1)]).items()}
    assert score() == want()
    changed = {"1": "york york", "2": "nothing here", "new": "a city"}
    made = Catalog().add(entity_table("t", spark.createDataFrame(list(changed.items()), "id string, body string"), "id"))
    entities = spark.createDataFrame([("1",), ("2",), ("new",), ("a",)], "e string")
    for _ in range(2):  # a batch that runs again changes nothing
        stored.update(facts(made, "body"), 1, entities)
    now.update(changed)
    del now["a"]
    assert score() == want() and stored.latest_tx() == 1
    stored.compact()
    assert score() == want() and len(stored.units._live()) == 1
    best = [(r["e"], r["score"]) for r in stored.search("york OR city").collect()]
    assert best == sorted(best, key=lambda r: (-r[1], r[0]))
    assert [(r["e"], r["score"]) for r in stored.search("york OR city", limit=5, offset=3).collect()] == best[3:8]


def test_hits_of_a_stored_index_hold_at_the_basis(spark, catalog, tmp_path):
    """The index knows all documents, the database those of its basis; texts join the hits at last."""
    stored = TextIndex(spark, f"file://{tmp_path}/ix").build(catalog)
    at = Catalog(text=stored).add(entity_table("t", catalog.tables["t"].df.where("id IN ('a', 'b')"), "id"))
    db = Db(spark, at)
    assert {r[0] for r in db.q('{:find [e v] :where [[(text-search :body "york") [[e v s]]]]}')} == {"a", "b"}
    assert {r[:2] for r in db.q('{:find [e a] :where [[(wildcard-text-search "york") [[e v a s]]]]}')} == {("a", "body"), ("b", "body")}
    assert db.q('{:find [e] :where [[(multi-text-search "body:york AND body:new") [[e s]]]]}') == {("a",), ("b",)}
    assert db.q('{:find [e] :where [[(text-search :body "\\"new york\\"") [[e v s]]]]}') == {("a",)}


@pytest.mark.parametrize(("query", "leaves", "keep"), CASES, ids=[c[0] for c in CASES])
def test_values_are_searched_as_their_index(catalog, texts, query, leaves, keep):
    scores = lambda found: {r["e"]: round(r["score"], 9) for r in found.collect()}
    assert scores(search_texts(facts(catalog, "body"), query, ["e"])) == scores(search(index(catalog, "body"), query, ["e"]))


def test_rows_that_repeat_a_value_count_together(spark):
    made = facts(Catalog().add(entity_table("t", spark.createDataFrame([("1", "new york, new york")] * 2 + [("2", "york")], "id string, body string"), "id")), "body")
    for found in (search(postings_of(made), '"new york"', ["e"]), search_texts(made, '"new york"', ["e"])):
        (row,) = found.collect()
        idf = math.log(1 + 1.5 / 1.5) + math.log(1 + 0.5 / 2.5)
        assert row["e"] == "1" and abs(row["score"] - idf * 4 * (K1 + 1) / (4 + K1 * (1 - B + B * 4 / 2.5))) < 1e-9


def test_postings_are_never_shuffled(spark, catalog, tmp_path, monkeypatch):
    """Neither to index values nor to compact segments, though some are stale."""
    written, write = [], TableStore.write

    def seen(self, df, order, sort=None, base=False):
        if self.path.endswith("postings"):
            written.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, df, order, sort, base)

    monkeypatch.setattr(TableStore, "write", seen)
    stored = TextIndex(spark, f"file://{tmp_path}/ix").build(catalog, "body")
    stored.update(facts(catalog, "body").limit(0), 1, spark.createDataFrame([("1",), ("2",)], "e string"))
    stored.compact()
    # What is stale is shuffled and broadcast; the postings' side of the last join isn't.
    assert "Exchange" not in written[0] and "BroadcastHashJoin" in written[-1] and "rangepartitioning" not in written[-1]
    assert not {"1", "2"} & {r["e"] for r in stored.current().select("e").distinct().collect()}


def test_values_are_read_once(spark, tmp_path):
    """A search of values analyzes each text once, whatever it computes from that."""
    spark.createDataFrame([("1", "new york"), ("2", "york city"), ("3", "...")], "id string, body string").write.parquet(f"{tmp_path}/t")
    at = Catalog().add(entity_table("t", spark.read.parquet(f"{tmp_path}/t"), "id"))
    found = Db(spark, at).df('{:find [e] :where [[(multi-text-search "body:york AND body:city") [[e s]]]]}')
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("2",)]
    assert "split(" not in plan and "[^" not in plan
