import itertools
import re
import zlib

import numpy as np

from tidemark.llm import queries, toxicity


def test_label_model_finds_accuracies_and_correlations(monkeypatch):
    """Votes drawn from known rates, with copies of a voter and a voter for clean; the prior is off and weighs little."""
    monkeypatch.setattr(toxicity, "PRIOR", 0.005)
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.3
    draw = lambda toxic, clean: np.where(truth, rng.random(6000) < toxic, rng.random(6000) < clean)
    rates = [(0.7, 0.02), (0.6, 0.05), (0.2, 0.2), (0.05, 0.5), (0.65, 0.03), (0.55, 0.04), (0.6, 0.03)]
    drawn = [draw(*r) for r in rates]
    votes = np.stack([*drawn, drawn[0], drawn[0]], axis=1).astype(float)
    hint = np.array([[0.1, 0.1, 0.25, 0.3, 0.1, 0.1, 0.1, 0.1, 0.1], [0.5, 0.5, 0.3, 0.1, 0.5, 0.5, 0.5, 0.5, 0.5]])
    model, post = toxicity.label_model(votes, hint, 0.4)
    linked = {tuple(sorted((j, int(p)))) for j, p in enumerate(model.parent) if p >= 0}
    assert len(linked & {(0, 7), (0, 8), (7, 8)}) == 2
    for j, (toxic, clean) in enumerate(rates):
        if model.parent[j] < 0:
            assert abs(model.speaks[1, 0, j] - toxic) < 0.08 and abs(model.speaks[0, 0, j] - clean) < 0.06
    assert sum(model.parent[:7] < 0) >= 5
    assert ((post > 0.5) == truth).mean() > 0.95
    once, alone = toxicity.label_model(votes[:, :7], hint[:, :7], 0.4)
    assert ((alone > 0.5) == (post > 0.5)).mean() > 0.99


def test_rows_on_which_all_abstain_stay_clean():
    """Half the rows are toxic, voters speak in groups, and most clean rows have no vote: they must not drift into the other class."""
    rng = np.random.default_rng(7)
    truth = rng.random(8000) < 0.45
    group = rng.integers(0, 4, 8000)
    votes = np.zeros((8000, 40))
    for j in range(40):
        votes[:, j] = np.where(truth & (group == j // 10), rng.random(8000) < 0.5, rng.random(8000) < 0.004)
    hint = np.stack([votes[~truth].mean(axis=0), votes[truth].mean(axis=0)])
    _, post = toxicity.label_model(votes, hint, 0.45)
    assert ((post > 0.5) == truth).mean() > 0.93 and post[~votes.any(axis=1)].max() < 0.4


def test_posterior_against_brute_force():
    rng = np.random.default_rng(4)
    votes = (rng.random((300, 5)) < 0.4).astype(float)
    votes[:, 3] = np.where(rng.random(300) < 0.9, votes[:, 1], votes[:, 3])
    model, post = toxicity.label_model(votes, np.clip(rng.random((2, 5)), 0.1, 0.9), 0.3)
    for row, p in zip(votes, post, strict=True):
        weight = []
        for c, start in ((0, 1 - model.prior), (1, model.prior)):
            for j in range(5):
                above = int(row[model.parent[j]]) if model.parent[j] >= 0 else 0
                start *= model.speaks[c, above, j] if row[j] else 1 - model.speaks[c, above, j]
            weight.append(start)
        assert abs(weight[1] / sum(weight) - p) < 1e-9


def test_no_label_enters_a_posterior(spark, make_docs):
    """Two documents of one text and different labels get one posterior, and so one score; a mislabelled one follows its voters."""
    rows = [(k, "you are a stupid idiot, moron" if k % 2 else "the weather is fine today") for k in range(80)]
    labels = spark.createDataFrame([(k, 1, k % 2 if k > 3 else 1 - k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(make_docs(rows), labels)
    assert {(r["doc_id"] % 2, r["score"] >= 0.5) for r in toxicity.score(make_docs(rows), model).collect()} == {(0, False), (1, True)}
    assert {v[1] for v in model.voters} == {0, 1} and all(v[2] > 0.9 for v in model.voters if not v[0].startswith(("pattern", "clean")))


def test_score_against_brute_force(spark, sf):
    """Each text's features, found again one by one, and the sum of their weights."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        total, low = model.bias, r["text"].lower()
        whole = ["".join(g) for k, g in itertools.groupby(low, lambda ch: ch.isalnum() and not ch.isdigit() and ch.isalpha() and ch != "_") if k]
        for name, weight in model.weights.items():
            if name.startswith("pattern:"):
                held = re.search(toxicity.PATTERNS[name[8:]], r["text"]) is not None
            elif name.startswith("lexicon:"):
                held = any(w in toxicity.LEXICONS[name[8:]].split() for w in whole)
            elif name.endswith("*"):
                held = any(w.startswith(name[:-1]) and len(w) > len(name) - 1 for w in whole)
            else:
                held = name in whole
            total += weight if held else 0
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9


def test_odd_rows_and_clashing_names(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + k, "you are a stupid idiot, moron" if k % 2 else "the weather is fine today") for k in range(60)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(100 + k, 1, k % 2) for k in range(60)] + [(None, 1, 1), (4, 1, None), (100, 0, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == len(rows) and scored[0].asDict().keys() >= {"node", "file", "score"}
    for r in scored:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)
        elif r["text"] is None or not r["text"].strip():
            assert r["score"] < 0.5


def test_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "idiot")])
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["score"] < 0.5
    empty = make_docs([])
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []


def test_other_columns_have_no_part(spark, make_docs):
    model = toxicity.Model({"idiot": 3.0}, -1.0, [], None)
    a, b = make_docs([(1, "an idiot")]), make_docs([(2, "an idiot")]).withColumn("lang", toxicity.F.lit("fr"))
    assert toxicity.score(a, model).first()["score"] == toxicity.score(b, model).first()["score"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op3_weak_supervision_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in held) / len(held) > 0.96
