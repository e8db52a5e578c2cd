import random

import corpus_pipeline
from tests.llm.test_bpe import brute as encoded
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_neardup import brute as components
from tidemark.llm import toxicity


def stages(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def write(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_against_brute_force(spark, make_docs, odd_rows, tmp_path):
    folder = f"file://{tmp_path}"
    rng = random.Random(5)
    prose = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    bench = [(k, prose(20)) for k in range(5)]
    rows = list(odd_rows)
    for k in range(100, 220):
        text = prose(50)
        rows.append((k, text + (" stupid moron idiot" if k % 7 == 0 else "") + (" " + bench[k % 5][1] if k % 11 == 0 else "")))
        if k % 13 == 0:
            rows.append((1000 + k, rows[-1][1] + " tail"))
    write(spark, folder, make_docs(rows), [(k, 1, int(k % 7 == 0)) for k in range(100, 220)], bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stages(spark, docs, folder)
    for name in ("toxicity", "near_duplicates", "decontamination"):
        assert out[name].columns == docs.columns
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {w for w, v in model.weights.items() if v > 1}
    assert texts(out["toxicity"]) == sorted((r for r in rows if not (bad & toxicity.features(r[1] or ""))), key=str)
    assert {i for i, _ in texts(out["toxicity"])} == {i for i, _ in rows if not (i is not None and 100 <= i < 220 and i % 7 == 0) and not (i is not None and i > 1000 and (i - 1000) % 7 == 0)}
    kept = texts(out["toxicity"])
    comp = {i: c for i, _, c in components(kept)}
    assert texts(out["near_duplicates"]) == sorted({(i, t) for i, t in kept if i is None or comp[i] == i}, key=str)
    kept = texts(out["near_duplicates"])
    hit = {d for d, _ in contaminated(kept, bench)}
    assert hit and texts(out["decontamination"]) == [r for r in kept if r[0] not in hit]
    kept = dict(texts(out["decontamination"]))
    final = {r["doc_id"]: r["n_tokens"] for r in out["bpe"].collect()}
    assert final == {i: len(encoded(t)[0]) // 4 for i, t in kept.items()}


def test_run_gives_the_rows_of_the_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_empty_tables(spark, make_docs, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, make_docs([]), [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
