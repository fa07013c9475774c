"""Toxicity by a classifier chain over hashed words and word beginnings.

The categories are predicted one after another; each linear model gets the document's features and the
probabilities of the categories before it. In training these probabilities are out-of-fold predictions,
as the models will meet unseen documents. The last category, toxic, is the label of the table. Those
before it are learned: the toxic documents of the sample are grouped into KINDS kinds by what marks them
(k-means over the features of the toxic side), and a category is being one of that kind.

Features are runs of letters of the whole text, A-Z as a-z, and their first bytes (PREFIXES), which
words of one family share, all known by a 64-bit hash. The models see which of the FEATURES that lie
farthest apart between the sample's toxic and clean documents are in the document; they are counted and
chosen in Spark, and only their bits come to the driver. The models are fitted on a bounded sample
(PER_CLASS documents of each class, whole texts), weighted to the classes' shares; documents of the
held-out fold are never learned from.

Defined cases: a null text counts as empty; an empty text is scored as one without known words;
repeated rows give a row each, alike; a null doc_id has fold 0; an id with labels 0 and 1 isn't learned
from; without labels of both classes every score is their share (0 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import documents, map_batches, texts_of
from presslake.llm.shingles import LETTERS, text_words
from presslake.llm.training import held_out, labelled_sample
from presslake.session import checkpoint, read

#: Learned categories before the last one, and bytes of word beginnings.
KINDS, PREFIXES = 3, (4, 6)
PER_CLASS, FEATURES, LEAST_DOCS, FOLDS, RIDGE, STEPS = 2000, 384, 4, 5, 2.0, 12
THRESHOLD = 0.3


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic model, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def found_features(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct features."""
    every = zip(text_words(texts, LETTERS), *(text_words(texts, LETTERS, p) for p in PREFIXES))
    return [np.unique(np.concatenate(own)) for own in every]


class Chain:
    """Features known by hash, sorted, and a linear model per category in order."""

    def __init__(self, known: np.ndarray, models: list[np.ndarray]):
        self.known, self.models = known, models

    def features(self, found: np.ndarray) -> np.ndarray:
        """Row of the known features that are among the hashes ``found``."""
        x = np.zeros(len(self.known))
        if len(self.known) and len(found):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            x[at[self.known[at] == found]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (documents, categories)."""
        given = x
        for w in self.models:
            given = np.concatenate([given, predict_linear(w, given)[:, None]], 1)
        return given[:, x.shape[1] :]


def kinds(x: np.ndarray, toxic: np.ndarray, count: int = KINDS) -> np.ndarray:
    """(documents, count): which kind each toxic document is of, by k-means over the features that are commoner in toxic ones; clean documents are of none."""
    out = np.zeros((len(x), count))
    marking = x[toxic].mean(0) > x[~toxic].mean(0)
    own = x[toxic][:, marking]
    own = own / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None]
    centres = own[:1]
    while len(centres) < min(count, len(own)):  # farthest from those so far
        centres = np.concatenate([centres, own[(own @ centres.T).max(1).argmin()][None]])
    for _ in range(20):
        kind = (own @ centres.T).argmax(1)
        new = np.array([own[kind == k].mean(0) if (kind == k).any() else centres[k] for k in range(len(centres))])
        centres = new / np.maximum(np.linalg.norm(new, axis=1), 1e-9)[:, None]
    out[np.flatnonzero(toxic), (own @ centres.T).argmax(1)] = 1
    return out


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Predictions of each document by a model that hasn't seen its fold."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold % FOLDS != k
        if rest.any() and not rest.all():
            out[~rest] = predict_linear(fit_linear(x[rest], y[rest], weight[rest]), x[~rest])
    return out


def fit_chain(known: np.ndarray, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> Chain:
    """``labels``: (documents, categories), the last one the target; ``x``: each document's known features."""
    chain = Chain(known, [])
    for y in labels.T:
        chain.models.append(fit_linear(x, y, weight))
        x = np.concatenate([x, out_of_fold(x, y, fold, weight)[:, None]], 1)
    return chain


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain | float:
    """A chain, or the share of label 1 where one class has no documents."""
    texts, counts = labelled_sample(docs, labels, "toxic", per_class)

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [f.view(np.int64) for f in found_features(texts_of(batch))]
            return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "found"])

        return step

    sample = checkpoint(map_batches(texts, "doc_id long, y int, found array<long>", start))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return counts.get(1, 0) / sum(counts.values()) if counts else 0.0
    each = sample.select("y", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    p, q = (F.col("a") + 0.5) / (sizes[1] + 1), (F.col("b") + 0.5) / (sizes[0] + 1)
    apart = F.abs(p - q) / F.sqrt((p + q) / 2 * (1 / sizes[1] + 1 / sizes[0]))
    chosen = each.filter(F.col("a") + F.col("b") >= LEAST_DOCS).orderBy(apart.desc(), "feature").limit(FEATURES).select("feature").collect()
    known = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))

    def bits():
        own = Chain(known, [])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.packbits(own.features(np.array(f, np.int64).view(np.uint64)).astype(bool)).tobytes() for f in batch.column("found").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "bits"])

        return step

    rows = sorted(map_batches(sample, "doc_id long, y int, bits binary", bits).collect())  # 2 * per_class rows of FEATURES bits at most
    y = np.array([r["y"] for r in rows])
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: len(known)] for r in rows], float).reshape(len(rows), len(known))
    share = np.array([counts[0], counts[1]]) / sum(counts.values())
    weight = (share / np.bincount(y) * len(y))[y]
    table = np.concatenate([kinds(x, y == 1), y[:, None]], 1).astype(float)
    return fit_chain(known, x, table, np.arange(len(y)), weight)


def score(docs: DataFrame, model: Chain | float, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a probability per category (p_kind<i>), score (toxic) and predicted; one narrow pass."""
    names = [f"p_kind{i}" for i in range(KINDS)]
    docs = docs.drop(*names, "score", "predicted")  # columns of these names give way
    columns = docs.columns

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            if isinstance(model, float):
                p = np.full((len(texts), len(names) + 1), model)
            else:
                p = model.predict(np.stack([model.features(f) for f in found_features(texts)]))
            return pa.record_batch([*(batch.column(c) for c in columns), *(pa.array(p[:, i]) for i in range(len(names) + 1)), pa.array((p[:, -1] >= threshold).astype(np.int32))], names=[*columns, *names, "score", "predicted"])

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, f"{fields}, {', '.join(f'{n} double' for n in names)}, score double, predicted int", start)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).withColumn("held_out", held_out(F.col("doc_id"))).drop("text")
