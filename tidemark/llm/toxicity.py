"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.shared import over

#: Parameters of the fit, which bound what it holds and not what it scores. Labelled rows, at most, that anything is learnt from; of either class half.
SAMPLE_ROWS = 20_000
#: Words and stems, at most, that the classifier knows: those that tell the classes apart best.
VOCABULARY = 6000
#: Voters, at most, that the label model weighs: the fixed ones and the best mined ones.
VOTERS = 160
#: A word or stem must be in so many sampled documents, and its count differ so much between the classes (log-likelihood ratio), ...
SUPPORT, EVIDENCE = 4, 18.0
#: ... and a mined voter speak so often for its class, at equal class sizes.
PRECISION = 0.8
#: How much the label model's prior counts for in each class, as a multiple of the rows: it holds the classes in their place, as votes alone would
#: let rows on which all voters abstain drift from one to the other.
PRIOR = 1.0
#: Twice the log-likelihood that a link between two voters must gain.
LINK = 30.0

#: Distinct words that a task keeps with their features before it starts anew.
WORDS_KEPT = 150_000
#: Fixed lexicon voters, by theme.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb loser losers clown clowns fool imbecile jerk pathetic worthless",
    "contempt": "scum trash filth vermin garbage disgusting vile repulsive",
    "threat": "kill die hurt destroy beat",
}
#: Fixed pattern voters.
PATTERNS = {
    "shouting": r"(?:\b[A-Z]{3,}\b[\s,!]+){3,}",
    "exclaim": r"!{3,}",
    "you_are": r"(?i)\byou(?:'re| are) (?:an? |such |all )?(?:idiot|moron|stupid|dumb|loser|clown|scum|trash|pathetic|worthless|disgusting)",
    "masked": r"(?i)\b\w+[*@#$]{2,}\w*",
}
#: Fixed pattern voters for the other class; they abstain where they don't match.
CLEAN = {
    "table": r"\|[^|\n]*\|[^|\n]*\|",
    "licence": r"[Ll]icen[cs]ed under |[Aa]ll rights reserved|Copyright \d{4}",
    "courtesy": r"[Tt]hank you|[Pp]lease |[Kk]ind regards",
}

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6, 7)
_THEMES = {word: f"lexicon:{theme}" for theme, words in LEXICONS.items() for word in words.split()}
_PATTERNS = {f"pattern:{name}": re.compile(pattern) for name, pattern in PATTERNS.items()}
_CLEAN = {f"clean:{name}": re.compile(pattern) for name, pattern in CLEAN.items()}


def word_features(word: str) -> list[str]:
    """The word, its stems (which end in `*`) and the fixed lexicon that lists it."""
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) > n), *([_THEMES[word]] if word in _THEMES else [])]


def features(text: str) -> set[str]:
    out = {name for name, pattern in (*_PATTERNS.items(), *_CLEAN.items()) if pattern.search(text)}
    for word in set(_WORD.findall(text.lower())):
        out.update(word_features(word))
    return out


@dataclass
class Model:
    """What the fit found: weights of the classifier, and of each voter its name, the class it speaks for (1 toxic, 0 clean) and how often it is right."""

    weights: dict[str, float]
    bias: float
    voters: list[tuple[str, int, float]]
    labels: LabelModel | None


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[label].update(features(text or ""))
        names = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][n] for n in names], pa.int64()), pa.array([found[0][n] for n in names], pa.int64())], names=["feature", "pos", "neg"])


def _vectors(vocabulary: dict[str, int]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [sorted(vocabulary[f] for f in features(text or "") if f in vocabulary) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(known, pa.list_(pa.int32()))], names=["label", "known"])

    return run


def _log_ratio(pos: np.ndarray, neg: np.ndarray, all_pos: int, all_neg: int) -> np.ndarray:
    """Log-likelihood ratio of each feature's counts against one rate for both classes."""
    n = all_pos + all_neg
    out = np.zeros(len(pos))
    for seen, total in ((pos, all_pos), (neg, all_neg)):
        for value, expected in ((seen, (pos + neg) * total / n), (total - seen, (n - pos - neg) * total / n)):
            out += 2 * np.where(value > 0, value * np.log(np.maximum(value, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


@dataclass
class LabelModel:
    """How a hidden class makes voters speak (1) or abstain (0).

    Voters form a forest: each speaks with a probability that depends on the class and on whether
    its parent speaks. `speaks[c, p, j]` is that of voter j in class c if its parent speaks (p = 1)
    or not (p = 0); for a root both are equal.
    """

    prior: float
    parent: np.ndarray
    speaks: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of votes; no label has a part in it."""
        above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0.0)
        score = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for c, sign in ((1, 1.0), (0, -1.0)):
            yes, no = np.log(self.speaks[c]), np.log1p(-self.speaks[c])
            # log P = no0 + v (yes0 - no0) + a (no1 - no0) + v a (yes1 - no1 - yes0 + no0)
            score += sign * (no[0].sum() + votes @ (yes[0] - no[0]) + above @ (no[1] - no[0]) + (votes * above) @ (yes[1] - no[1] - yes[0] + no[0]))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _forest(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Parent of each voter (-1: none): the heaviest forest by mutual information given the class, of links that gain LINK at least."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    for w in weight:
        total = w.sum() + 1e-9
        both = (votes * w[:, None]).T @ votes
        one = np.diag(both).copy()
        for n, expected in (
            (both, np.outer(one, one)), (one[:, None] - both, np.outer(one, total - one)),
            (one[None, :] - both, np.outer(total - one, one)), (total - one[:, None] - one[None, :] + both, np.outer(total - one, total - one)),
        ):
            n = np.maximum(n, 0)
            gain += 2 * np.where(n > 1e-6, n * np.log(np.maximum(n, 1e-12) * total / np.maximum(expected, 1e-12)), 0)
    np.fill_diagonal(gain, 0)
    parent, best, link = np.full(m, -1), np.full(m, LINK), np.full(m, -1)
    out = np.ones(m, bool)
    for _ in range(m):
        # The voter outside that has the strongest link to one inside; a root, if none has.
        j = int(np.argmax(np.where(out, best, -1)))
        parent[j], out[j] = link[j], False
        better = out & (gain[j] > best)
        best[better], link[better] = gain[j][better], j
    return parent


def _estimate(votes: np.ndarray, post: np.ndarray, parent: np.ndarray, hint: np.ndarray, share: float) -> LabelModel:
    """Probabilities from rows that count for each class as their posterior says, and from the prior, which counts as PRIOR times all rows; the class's share is the prior's."""
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0.0)
    speaks = np.empty((2, 2, votes.shape[1]))
    for c, w in enumerate((1 - post, post)):
        more = PRIOR * len(votes) + 1
        rate = (w @ votes + more * hint[c]) / (w.sum() + more)
        n1, v1 = w @ above, w @ (above * votes)
        n0, v0 = w.sum() - n1, w @ votes - v1
        linked = parent >= 0
        speaks[c] = np.where(linked, [(v0 + rate) / (n0 + 1), (v1 + rate) / (n1 + 1)], rate)
    return LabelModel(share, parent, np.clip(speaks, 1e-6, 1 - 1e-6))


def label_model(votes: np.ndarray, hint: np.ndarray, share: float, rounds: int = 40) -> tuple[LabelModel, np.ndarray]:
    """The generative model of 0/1 votes (1: the voter speaks, 0: it abstains), and each row's posterior.

    `hint` is a prior: how often each voter speaks in either class, and `share` that of class 1;
    it counts as PRIOR times the rows. Expectation and maximisation fit accuracies and correlations to
    the votes alone, starting from what the prior makes of those who speak: what voters share
    beyond the class is in the likelihood, as a forest of dependent voters that is learnt anew
    every ten rounds, so a copy of a voter adds nothing.
    """
    hint = np.clip(hint, 1e-4, 1 - 1e-4)
    spoken = votes.sum(axis=1)
    score = np.log(share / (1 - share)) + votes @ np.log(hint[1] / hint[0]) / np.sqrt(np.maximum(spoken, 1))
    post = np.where(spoken > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.2 * share)
    for step in range(rounds):
        parent = _forest(votes, np.stack([1 - post, post])) if step % 10 == 0 else model.parent
        model = _estimate(votes, post, parent, hint, share)
        new = model.posterior(votes)
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-5 and step % 10 == 9:
            break
    return model, post


def _logistic(rows: list[np.ndarray], targets: np.ndarray, width: int, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights on 0/1 features by full-batch Adam on the soft targets, with a small quadratic penalty."""
    owner, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    share = np.clip(targets.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(owner, w[column], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) / len(rows)
        g, gb = np.bincount(column, error[owner], width) + 1e-5 * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / a) / (np.sqrt(v / c) + 1e-9)
        b -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-9)
    return w, b


def held_out(id_column: object) -> object:
    """Rows that nothing is learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Mine voters from a bounded sample of labelled rows outside the held-out fold, fit the label model to their votes and the classifier to its posteriors.

    Voters are fixed lexicons and patterns, and words and stems that the sample has far more often
    in one class; each speaks for toxic or for clean, or abstains. The labels give the label model
    a prior on how often each voter speaks in a class; posteriors come from the votes, and the classifier learns
    from posteriors only.

    Rows without label or id are not used; of a doc_id's repeated labels the largest counts. With
    no labelled row of one class the model scores all rows alike, below 0.5.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where("label IN (0, 1)")
    numbers = {r["label"]: r["c"] for r in usable.groupBy("label").agg(F.count("*").alias("c")).collect()}
    if len(numbers) < 2:
        return Model({}, -2.0, [], None)
    # A threshold on a hash of the id takes half the sample, about, from either class.
    bound = F.when(F.col("label") == 1, F.lit(min(1.0, sample_rows / 2 / numbers[1]))).otherwise(F.lit(min(1.0, sample_rows / 2 / numbers[0])))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound * (1 << 30))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label")
    totals = rows.groupBy("label").agg(F.count("*").alias("c"))
    counts = over(rows, _counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= SUPPORT)
    seen = {r["label"]: r["c"] for r in totals.collect()}
    if len(seen) < 2:
        return Model({}, -2.0, [], None)
    lift = F.log((F.col("pos") + 0.5) / (seen[1] + 1)) - F.log((F.col("neg") + 0.5) / (seen[0] + 1))
    best = counts.withColumn("lift", lift).withColumn("rank", F.abs("lift") * F.sqrt(F.col("pos") + F.col("neg"))).orderBy(F.desc("rank"), "feature").limit(VOCABULARY).toPandas()
    told = _log_ratio(best["pos"].to_numpy(np.float64), best["neg"].to_numpy(np.float64), seen[1], seen[0]) >= EVIDENCE
    best = best[told | best["feature"].str.contains(":", regex=False)].reset_index(drop=True)
    vocabulary = {f: k for k, f in enumerate(best["feature"])}
    share = ((best["pos"] / seen[1]) / (best["pos"] / seen[1] + best["neg"] / seen[0])).to_numpy()
    voters = [k for k in range(len(best)) if max(share[k], 1 - share[k]) >= PRECISION or ":" in best["feature"][k]][:VOTERS]
    side = [0 if best["feature"][k].startswith("clean:") or (share[k] < 0.5 and ":" not in best["feature"][k]) else 1 for k in voters]
    got = over(rows, _vectors(vocabulary), "label int, known array<int>").toPandas()
    known = [np.asarray(k, np.int32) for k in got["known"]]
    place = {k: j for j, k in enumerate(voters)}
    votes = np.zeros((len(known), len(voters)))
    for r, ks in enumerate(known):
        votes[r, [place[k] for k in ks.tolist() if k in place]] = 1
    counts = best[["neg", "pos"]].to_numpy(np.float64)[voters]
    model, post = label_model(votes, counts.T / np.array([[seen[0]], [seen[1]]]), min(max(float(got["label"].mean()), 0.01), 0.99))
    spoken = np.maximum(votes.sum(axis=0), 1)
    right = np.where(np.array(side) == 1, post @ votes, (1 - post) @ votes) / spoken
    # The clean patterns vote only; the classifier goes by words, stems and the other patterns.
    learnt = [f for f in vocabulary if not f.startswith("clean:")]
    column = {vocabulary[f]: j for j, f in enumerate(learnt)}
    weights, bias = _logistic([np.array([column[k] for k in ks.tolist() if k in column], np.int32) for ks in known], post, len(learnt))
    named = list(zip([best["feature"][k] for k in voters], side, right.tolist(), strict=True))
    return Model({f: float(w) for f, w in zip(learnt, weights, strict=True) if abs(w) > 1e-4}, float(bias), named, model)


class _Hits(dict):
    def __init__(self, known: dict[str, int]) -> None:
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = hit = tuple(self.known[f] for f in word_features(word) if f in self.known)
        return hit


def _scores(model: Model, at: int, made: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits({f: k for k, f in enumerate(model.weights)})
        weights = list(model.weights.values())
        patterns = [(k, _PATTERNS[f]) for k, f in enumerate(model.weights) if f in _PATTERNS]
        for batch in batches:
            out = []
            for value in batch.column(at):
                text = value.as_py() or ""
                found = {k for k, pattern in patterns if pattern.search(text)}
                for word in set(_WORD.findall(text.lower())):
                    if hit := hits[word]:
                        found.update(hit)
                out.append(model.bias + sum(weights[k] for k in sorted(found)))
            score = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, made])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the toxicity score (0 to 1) of each row's whole text in column `name`; no other column has a part in it.

    Null and empty texts get the score of no evidence. Rows, nulls, repeats and other columns
    stay; a column called `name` is replaced. Scoring needs no shuffle.
    """
    kept = docs.drop(name)
    made = next(n for k in range(len(kept.columns) + 1) if (n := f"score_{k}") not in kept.columns)
    schema = StructType([*kept.schema.fields, StructField(made, DoubleType())])
    return over(kept, _scores(model, kept.columns.index("text"), made), schema).withColumnRenamed(made, name)
