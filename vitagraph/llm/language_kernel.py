"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of 1 to ``MAX_N`` lower-cased code points
(presence, not counts), told apart by 32-bit hashes.  The kernel of two texts is the size
of the common set over the geometric mean of both sizes.  The Nyström method maps the
kernel onto a bounded number of landmark texts, and kernel ridge regression is solved
there for each language against the rest.

The solution is a weighted sum of kernels with the landmarks.  As the kernel is linear in
the presence vectors, that sum is one weight for each n-gram of the landmarks and language,
so a batch of texts is scored by a single matrix product: presence matrix times weights.

Learning reads a bounded sample (``MAX_TRAIN`` texts, shared evenly by the languages, by
the smallest hash).  The landmarks reach the driver; of the other texts only their kernels
with these do, which executors work out.  Whole texts are used there and in scoring.
Landmarks are texts of at most ``LANDMARK_CHARS`` code points; longer ones are learned from,
but serve as landmarks only where there are no others.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every text
when nothing can be learned (no labelled text, empty table).  A null doc_id counts as held
out.  Repeated rows get equal results, and are learned from once.  Languages with equal
scores: the first by name.  Very long texts have no more n-grams than code points times
``MAX_N``; none are folded together.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize

MAX_N = 4
#: Bounds on what is learned from: texts (so no more languages, the most frequent), landmarks, and their length.
MAX_TRAIN = 2_000
MAX_LANDMARKS = 256
LANDMARK_CHARS = 20_000
RIDGE = 1e-2
BATCH = 64
PART = 1 << 20  # code points looked at together
_STEP = np.uint32(2654435761)


def presence(text: str) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text."""
    lowered, made = text.lower(), []
    for at in range(0, max(1, len(lowered)), PART):
        points = np.frombuffer(lowered[at : at + PART + MAX_N - 1].encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(points), np.uint32)
        part = []
        for n in range(1, MAX_N + 1):
            if n > len(points):
                break
            h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * _STEP
            h ^= h >> np.uint32(15)
            part.append(h * np.uint32(2246822519) + np.uint32(n))
        if part:
            made.append(np.unique(np.concatenate(part)))
    return made[0] if len(made) == 1 else np.unique(np.concatenate(made)) if made else np.empty(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """A row for each set with 1 / sqrt(its size) at its n-grams of the sorted vocabulary."""
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, s in zip(out, sets, strict=True):
        at = np.searchsorted(vocabulary, s)
        at[at == len(vocabulary)] = 0
        row[at[vocabulary[at] == s]] = 1 / np.sqrt(len(s))
    return out


class Model:
    """Weights of each n-gram of the landmarks for each language."""

    def __init__(self, langs: list[str], vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.vocabulary, self.weights, self.bias = langs, vocabulary, weights, bias

    def score(self, texts: list[str]) -> np.ndarray:
        """One row of one-versus-rest scores for each text, by one matrix product over the n-grams of the batch."""
        sets = [presence(t) for t in texts]
        seen = np.unique(np.concatenate(sets))
        at = np.searchsorted(self.vocabulary, seen)
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == seen
        return matrix(sets, seen[hit]) @ self.weights[at[hit]] + self.bias


def landmarks(labels: list[str], long: list[bool]) -> list[int]:
    """Which training texts are landmarks: the languages in turn, so each has its share; long ones last."""
    turn: dict[str, int] = {}
    order = []
    for i, lab in enumerate(labels):
        if not long[i] or all(long):
            order.append((turn.setdefault(lab, 0), lab, i))
            turn[lab] += 1
    return [i for _, _, i in sorted(order)[:MAX_LANDMARKS]]


def fit(marks: list[np.ndarray], kernels: np.ndarray, labels: list[str]) -> Model:
    """Nyström kernel ridge regression from the landmarks' n-grams and each training text's kernels with them."""
    langs, at = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
    y = np.where(at[:, None] == np.arange(len(langs)), 1.0, -1.0)
    vocabulary = np.unique(np.concatenate(marks))
    land = matrix(marks, vocabulary)
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.hstack([kernels @ root, np.ones((len(labels), 1))])
    # each language weighs the same, however many texts it has
    share = 1 / np.bincount(at)[at] * len(labels) / len(langs)
    left = z.T @ (z * share[:, None]) + RIDGE * np.eye(z.shape[1])
    beta = np.linalg.solve(left, z.T @ (y * share[:, None]))
    alpha = root @ beta[:-1]
    return Model(langs.tolist(), vocabulary, (land.T @ alpha.astype(np.float32)).astype(np.float32), beta[-1])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame) -> Model | None:
    """Learn from the labelled texts that aren't held out."""
    able = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_TRAIN).collect()
    if not counts:
        return None
    each = max(1, MAX_TRAIN // len(counts))
    # a threshold on a uniform hash lets through a few more than wanted; the rest falls to the exact cut below
    upto = {r["lang"]: min(1.0, (1.2 * each + 40) / r["count"]) for r in counts}
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[F.lit(x) for kv in upto.items() for x in kv])[F.col("lang")]
    picked = able.withColumn("h", h).where((F.col("h") < limit) & F.col("text").rlike(r"\p{L}"))
    # rows that repeat each other are picked together: they count once
    picked = picked.groupBy("lang", "h", "doc_id").agg(F.max("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = materialize(picked.withColumn("nth", nth).where(F.col("nth") <= each), "language-sample")
    rows = picked.select("lang", "h", "doc_id", (F.length("text") > LANDMARK_CHARS).alias("long")).collect()  # MAX_TRAIN at most
    rows.sort(key=lambda r: (r["lang"], r["h"], r["doc_id"]))
    if not rows:
        return None
    labels = [r["lang"] for r in rows]
    chosen = landmarks(labels, [r["long"] for r in rows])
    keys = picked.sparkSession.createDataFrame([(rows[i]["lang"], rows[i]["h"], rows[i]["doc_id"]) for i in chosen], "lang string, h double, doc_id bigint")
    texts = picked.join(F.broadcast(keys), ["lang", "h", "doc_id"], "left_semi").select("lang", "h", "doc_id", "text").collect()
    texts.sort(key=lambda r: (r["lang"], r["h"], r["doc_id"]))
    marks = [presence(r["text"]) for r in texts]
    vocabulary = np.unique(np.concatenate(marks))

    def make():
        land = matrix(marks, vocabulary)

        def step(columns: list[list]) -> list[list]:
            made = [(matrix([presence(t)], vocabulary) @ land.T)[0].astype(float).tolist() for t in columns[3]]
            return [columns[0], columns[1], columns[2], made]

        return step

    spread = picked.repartition(min(64, max(1, len(rows) // 32)), "doc_id")
    got = arrow_map(
        spread, [F.col("lang"), F.col("h"), F.col("doc_id"), F.col("text")], "lang string, h double, doc_id bigint, k array<double>", make
    ).collect()
    got.sort(key=lambda r: (r["lang"], r["h"], r["doc_id"]))
    return fit(marks, np.array([r["k"] for r in got]), [r["lang"] for r in got])


SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of each text; no shuffle."""

    def make():
        def step(columns: list[list]) -> list[list]:
            doc_ids, held, texts = columns
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for k in range(0, len(at), BATCH):
                part = at[k : k + BATCH]
                made = model.score([texts[i] for i in part])
                for i, best, row in zip(part, made.argmax(axis=1), made, strict=True):
                    langs[i] = model.langs[best]
                    scores[i] = float(min(1.0, max(0.0, (1 + row[best]) / 2)))
            return [doc_ids, held, langs, scores]

        return step

    doc_id = F.col("doc_id").cast("long")
    return arrow_map(
        docs, [doc_id.alias("doc_id"), held_out(doc_id).alias("held"), F.col("text").cast("string").alias("text")], SCHEMA, make
    )


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
