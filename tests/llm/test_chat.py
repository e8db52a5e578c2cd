import random
from collections import defaultdict

from tidemark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, place long, n_turns string, k long, row long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", 4, 5) for r in rows], SCHEMA)


def brute(rows):
    nulls = lambda v: (v is not None, v if v is not None else 0)
    held = defaultdict(list)
    for c, t, role, text in rows:
        held[c].append((nulls(t), (role is not None, role or ""), (text is not None, text or ""), role, text))
    said = {c: [(r[3], r[4]) for r in sorted(v, key=lambda r: r[:3])] for c, v in held.items()}
    out = {}
    for c, turns in said.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in said.values())
        twin = any(o == turns and d is not None and (c is None or d < c) for d, o in said.items() if d != c)
        if not longer and not twin:
            out[c] = "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns)
    return out


def run(df):
    whole = defaultdict(list)
    for r in chat.render(chat.collapse(df)).collect():
        whole[r["conv_id"]].append((r["segment"], r["rendered"]))
    return {c: "".join(t for _, t in sorted(v)) for c, v in whole.items()}


def snapshots():
    rng = random.Random(8)
    rows, conv = [], 0
    for _ in range(40):
        turns = [(rng.choice(("user", "assistant")), rng.choice(("hi", "yes", "no", "", "why"))) for _ in range(rng.randrange(1, 12))]
        for n in rng.sample(range(1, len(turns) + 1), min(3, len(turns))):
            conv += 1
            rows += [(conv, k, *t) for k, t in enumerate(turns[:n])]
    rng.shuffle(rows)
    return rows


def test_snapshots_against_brute_force(spark):
    rows = snapshots()
    assert run(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", ""), (3, 0, None, "x"), (4, 0, "", "x"), (5, None, "user", "first"), (5, 0, "user", "second"), (6, 0, "user", "first"), (None, 0, "user", "first"), (None, 1, "user", "second"), (7, 0, "a", "same"), (7, 0, "a", "same"), (8, 0, "a", "same"), (9, 3, "user", "first"), (9, 9, "user", "second")]
    assert run(frame(spark, rows)) == brute(rows)


def test_long_conversation_in_segments(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 7)
    rows = [(1, k, "user", f"turn {k}") for k in range(500)] + [(2, k, "user", f"turn {k}") for k in range(499)] + [(3, k, "user", f"turn {k}") for k in range(498)] + [(3, 499, "user", "else")]
    assert run(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert run(frame(spark, [])) == {}


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op10_snapshot_collapse(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: r["rendered"] for r in queries.op10_snapshot_collapse(spark, sf).collect()} == brute(rows)
