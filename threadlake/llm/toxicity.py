"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the rest of the corpus is
unlabelled and holds toxic documents too, in a share given by the class prior.
Linear numpy classifiers minimise the prior-corrected risk, whose part for the
negatives is kept from going below zero.  Which features tell toxic documents
apart is counted over every unlabelled text; the weights are fitted on a bounded
sample; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import record, save

#: Defaults of ``fit``: about how many confirmed toxic documents and unlabelled ones the weights are fitted on, and how many features are kept.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 2_000
#: A feature is in at least so many positives and so many standard errors commoner in them.
LEAST_POSITIVES, LEAST_SHARE, LEAST_Z = 4, 0.01, 8.0
CLASSIFIERS, STEPS, RATE, LASSO = 3, 300, 0.1, 2e-4
DEFAULT_PRIOR = 0.1
_letters = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, and stems of four to six letters marked with ``^``."""
    words = set(_letters.findall((text or "").lower()))
    out = set(words)
    for n in (4, 5, 6):
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


class Finder:
    """Which of the given features a text has, without listing all it has."""

    def __init__(self, names):
        self.words, self.stems = {f for f in names if f[0] != "^"}, {f[1:] for f in names if f[0] == "^"}

    def __call__(self, text: str | None) -> list[str]:
        seen = set(_letters.findall((text or "").lower()))
        stems = {w[:n] for n in (4, 5, 6) for w in seen if len(w) > n} if self.stems else set()
        return [*(self.words & seen), *("^" + x for x in self.stems & stems)]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None]) -> list[float]:
        find, out = Finder(self.weights), []
        for t in texts:
            total = math.fsum([self.bias, *(self.weights[f] for f in find(t))])  # exact, so the order does not matter
            out.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[list[int]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def train(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise  prior*E_p[l(x)] + max(0, E_u[l(-x)] - prior*E_p[l(-x)])  with logistic loss and a lasso."""
    p, u = _Rows(positive, width), _Rows(unlabelled, width)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Derivatives of the loss as a negative: the sigmoid itself; as a positive: the sigmoid less one.
        if negative >= 0:
            gp, gu = prior * (sp - 1) / p.n - prior * sp / p.n, su / u.n
        else:  # the estimate went below zero, which only overfitting does: step back along the negatives' part
            gp, gu = prior * sp / p.n, -su / u.n
        g = np.append(p.transposed_dot(gp) + u.transposed_dot(gu), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - RATE * LASSO)
    return w, b


def held_out(id_col):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _pick(df: DataFrame, most: int, n: int) -> DataFrame:
    """About ``most`` of ``n`` rows, the same ones on every run; all if there are no more."""
    return df if n <= most else df.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most / n))


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        c: Counter = Counter()
        for t in b["text"]:
            c.update(features(t))
        yield pd.DataFrame({"feature": pd.Series(list(c), dtype=object), "n": list(c.values())}, columns=["feature", "n"])


def _count_known(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, c = Finder(names), Counter()
        for b in batches:
            for t in b["text"]:
                c.update(find(t))
        yield pd.DataFrame({"feature": pd.Series(list(c), dtype=object), "n": list(c.values())}, columns=["feature", "n"])

    return run


def telling(positive: DataFrame, texts: DataFrame, n_positive: int, n_texts: int, prior: float, most: int = MAX_FEATURES) -> list[str]:
    """Features commoner in ``positive`` than in negatives, most telling first.

    Shares in positives come from the bounded set of positives, shares in the
    corpus from every one of ``texts``; those of negatives are what the prior
    leaves.  The driver and the tasks hold the features that at least
    ``LEAST_SHARE`` of the positives have, which do not grow with the corpus.
    """
    counted = positive.mapInPandas(_count_features, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("p"))
    in_positive = {r["feature"]: r["p"] for r in counted.where(F.col("p") >= max(LEAST_POSITIVES, LEAST_SHARE * n_positive)).collect()}
    counted = texts.mapInPandas(_count_known(sorted(in_positive)), "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("u"))
    in_all = {r["feature"]: r["u"] for r in counted.collect()}
    scored = []
    for f, p in in_positive.items():
        rate = p / n_positive
        negatives = max(0.0, (in_all.get(f, 0) / n_texts - prior * rate) / (1 - prior))
        z = (rate - negatives) / math.sqrt((negatives + 1 / n_texts) * (1 - min(negatives, 0.999)) / n_positive)
        if z >= LEAST_Z:
            scored.append((-z, f))
    return [f for _, f in sorted(scored)[:most]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model | None:
    """A model from rows not held out; None without a confirmed toxic document.

    The prior is the share of toxic documents among the labelled ones.  Null ids,
    labels and texts are left out of fitting; a repeated id is toxic if any of its labels says so.

    ``max_positive`` bounds the confirmed toxic documents read, ``max_unlabelled`` the
    unlabelled ones that the weights are fitted on (about; both picked by a hash of the
    id), ``max_features`` the features, most telling first.  Which features those are
    is counted over all unlabelled documents.  The driver gets these counts and, for the
    sample, which of the chosen features each document has.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id")))
    n_labels, n_toxic = known.agg(F.count("*"), F.sum(F.expr("int(label = 1)"))).first()
    if not n_toxic:
        return None
    prior = min(0.9, n_toxic / n_labels) if n_toxic < n_labels else DEFAULT_PRIOR
    positive = _pick(known.where("label = 1").select("doc_id"), max_positive, n_toxic)
    n_texts = texts.count()
    # At most 2 * max_positive ids, so the texts need not move to meet them.
    chosen = texts.join(F.broadcast(positive.limit(2 * max_positive)), "doc_id").select(F.lit(True).alias("positive"), "text")
    sample = save(chosen.unionByName(_pick(texts, max_unlabelled, n_texts).select(F.lit(False).alias("positive"), "text")), "sample")
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return None
    names = telling(sample.where("positive").select("text"), texts.select("text"), n[True], n_texts, prior, max_features)
    at = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(names)
        for b in batches:
            yield pd.DataFrame({"positive": b["positive"], "hits": [sorted(at[f] for f in find(t)) for t in b["text"]]})

    rows = sorted((r["positive"], r["hits"]) for r in sample.mapInPandas(hits, "positive boolean, hits array<int>").collect())
    p, u = [h for is_p, h in rows if is_p], [h for is_p, h in rows if not is_p]
    weights, bias = np.zeros(len(names)), 0.0
    for k in range(CLASSIFIERS):  # each on its own resample; their logits are averaged
        rng = np.random.default_rng(k)
        own_p, own_u = ([x[i] for i in rng.integers(0, len(x), len(x))] for x in (p, u))
        w, b = train(own_p, own_u, len(names), prior)
        weights, bias = weights + w / CLASSIFIERS, bias + b / CLASSIFIERS
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias)


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``rec`` (the whole row) and ``score`` for every row, from its whole text alone.

    Null and empty texts get the score of a text without features; without a model
    every score is 0.  Repeated rows score alike; an empty table gives an empty
    result; extra columns travel in ``rec``.
    """
    if model is None:
        return docs.select(record(docs).alias("rec"), F.lit(0.0).alias("score"))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()), dtype=float)

    return docs.select(record(docs).alias("rec"), run(F.col(f"`{text_col}`")).alias("score"))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row; null ids count as learnt from, null and empty texts score as texts without features, repeated rows alike; an empty table gives an empty result, and no confirmed toxic document the score 0 throughout."""
    model = fit(docs, labels, id_col, text_col, label_col)
    only = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = score(only, model).select("rec.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The input's columns, without the documents scored 0.5 or more; null ids, null texts and repeated rows are scored like any other, extra columns stay."""
    return score(docs, fit(docs, labels, id_col, text_col, label_col), text_col).where("score < 0.5").select("rec.*")
