"""Toxicity by a classifier chain.

Categories are predicted one after another.  The linear model of a category sees the words
of a text and the probabilities that the chain gave to all earlier categories.  Later
models are trained on out-of-fold probabilities of the earlier ones, that is, on what
these say about texts they haven't seen, as will be the case in use.

Words are lower-cased (A-Z) and stripped of punctuation at both ends; a text is the set of
its words and of their beginnings (``PREFIXES`` characters, for inflected and compound
words), folded into ``2 ** BITS`` bins.  The models are logistic regressions with an
L1 penalty, fitted on a bounded sample of labelled documents (``MAX_TRAIN`` of them, by
the smallest hash of doc_id).  All documents are scored, over their whole texts.

Edge cases: a null or wordless text has probability 0 in every category and is not toxic;
documents without a label are scored like all others; labels that are null are not
learned from, and of several labels of one document the greatest counts; without both
classes in a category its probability is the share of the positive class; repeated rows
are scored alike, and of several texts of one labelled id the greatest is learned from; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BITS = 18
PREFIXES = (4, 5, 6, 7, 8, 9)
MAX_TRAIN = 8_000
FOLDS = 3
STEPS = 60
L1 = 2e-3
MIN_DOCS = 5
THRESHOLD = 0.6
STRIP = b".,;:!?\"'()[]{}<>*#&%$|-_/\\"


class Bins(dict):
    """Word (bytes) to its bins, four bytes each: the word itself and its beginnings; bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 300_000:
            self.clear()
        bare = word.strip(STRIP).decode()
        keys = [bare, *("^" + bare[:n] for n in PREFIXES if n < len(bare))] if bare else []
        value = self[word] = b"".join((xxhash.xxh3_64_intdigest(k) >> (64 - BITS)).to_bytes(4, "little") for k in keys)
        return value


def bins(text: str | None, known: Bins) -> np.ndarray:
    words = text.encode().lower().split() if text else []
    flags = set(words) if len(words) > 50_000 else words  # a very long text: its words once
    return np.unique(np.frombuffer(b"".join(map(known.__getitem__, flags)), np.int32))


class Linear:
    """Logistic regression on bins and a few dense inputs."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def prob(self, sets: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        raw = np.array([self.weights[s].sum() for s in sets]) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_linear(sets: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> Linear:
    """Proximal AdaGrad on the balanced log loss."""
    size = 1 << BITS
    w, v, b = np.zeros(size), np.zeros(dense.shape[1]), 0.0
    if y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Linear(w, v, float(np.log(rate / (1 - rate))))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    often = np.bincount(flat, minlength=size) >= MIN_DOCS
    keep = often[flat]
    owner = owner[keep]
    bins_used = np.flatnonzero(often)
    place = np.zeros(size, np.int32)
    place[bins_used] = np.arange(len(bins_used))
    flat = place[flat[keep]]
    u = np.zeros(len(bins_used))
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    seen_u, seen_v, seen_b = np.full(len(u), 1e-12), np.full(len(v), 1e-12), 1e-12
    step = 0.5
    for _ in range(STEPS):
        raw = np.bincount(owner, weights=u[flat], minlength=len(y)) + dense @ v + b
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * share
        g = np.bincount(flat, weights=err[owner], minlength=len(u))
        seen_u += g * g
        rate = step / np.sqrt(seen_u)
        u -= rate * g
        u = np.sign(u) * np.maximum(np.abs(u) - rate * L1, 0)
        g = dense.T @ err
        seen_v += g * g
        v -= step / np.sqrt(seen_v) * g
        g = err.sum()
        seen_b += g * g
        b -= step / np.sqrt(seen_b) * g
    w[bins_used] = u
    return Linear(w, v, float(b))


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of ``labels``, in order."""
    earlier = np.zeros((len(sets), 0))
    chain = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        chain.append(fit_linear(sets, earlier, y))
        if k + 1 < labels.shape[1]:
            out = np.empty(len(sets))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                if len(inside) and len(outside):
                    part = fit_linear([sets[i] for i in inside], earlier[inside], y[inside])
                    out[outside] = part.prob([sets[i] for i in outside], earlier[outside])
                elif len(outside):
                    out[outside] = chain[-1].prob([sets[i] for i in outside], earlier[outside])
            earlier = np.column_stack([earlier, out])
    return chain


def apply_chain(chain: list[Linear], sets: list[np.ndarray]) -> np.ndarray:
    """A probability for each text and category."""
    made = np.zeros((len(sets), 0))
    for model in chain:
        made = np.column_stack([made, model.prob(sets, made)])
    made[[len(s) == 0 for s in sets]] = 0.0
    return made


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> list[Linear] | None:
    """``categories``: name to an expression over ``labels`` that is 1, 0 or null, in chain order."""
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    marked = marked.dropna().groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most MAX_TRAIN rows of a few numbers
    # one text for each id, however many rows bear it: no more than MAX_TRAIN reach the driver
    rows = rows.groupBy("doc_id", *names).agg(F.max("text").alias("text"))

    def make():
        known = Bins()

        def step(columns: list[list]) -> list[list]:
            return [columns[0], [bins(t, known).tobytes() for t in columns[1]], *columns[2:]]

        return step

    schema = "doc_id bigint, bins binary, " + ", ".join(f"{n} int" for n in names)
    got = arrow_map(rows, [F.col("doc_id"), F.col("text"), *map(F.col, names)], schema, make).collect()
    if not got:
        return None
    rows_ = sorted(got, key=lambda r: r["doc_id"])
    del got
    sets = [np.frombuffer(r["bins"], np.int32) for r in rows_]  # no copy: the rows stay
    y = np.array([[r[n] for n in names] for r in rows_], float)
    folds = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in rows_])
    return fit_chain(sets, y, folds)


def score(docs: DataFrame, chain: list[Linear] | None, names: list[str]) -> DataFrame:
    """doc_id, p_<category> of each category, and ``toxic``: the last one reaches THRESHOLD."""

    def make():
        known = Bins()

        def step(columns: list[list]) -> list[list]:
            sets = [bins(t, known) for t in columns[1]]
            p = apply_chain(chain, sets) if chain else np.zeros((len(sets), len(names)))
            return [columns[0], *(p[:, k].tolist() for k in range(len(names))), (p[:, -1] >= THRESHOLD).tolist()]

        return step

    schema = "doc_id bigint, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean"
    return arrow_map(
        docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], schema, make
    )


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return score(docs, train(docs, labels, categories), list(categories))
