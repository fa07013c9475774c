"""Quality classifier: a byte-level convolutional network in numpy.

Every document is read whole as bytes. Learned filters of WIDTH bytes run over it at a stride of two;
the filters' responses are max-pooled over chunks of two neighbouring blocks, so that chunks overlap
by half and cover the whole text. Means and maxima of the chunks' values over the document go
through one logistic unit to a probability. A byte's share of a filter's response depends on its
value and place alone, so that a filter is WIDTH tables of 256 numbers, and scoring is table look-ups.

The network is trained by gradient steps on a bounded sample of labelled documents (PER_CLASS of each
class, whole texts), with weights that restore the classes' shares. Documents of the held-out fold are never learned from; labels, language,
source and id are no inputs of a score.

A zero byte holds nothing: its part in every filter is zero, so that what fills up a text's last block
says nothing.

Defined cases: a null text counts as empty; an empty text is scored as one of zero bytes alone;
repeated rows give a row each, alike; a null doc_id has fold 0; without labels of both classes every
score is their share (0.5 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import documents, map_batches, texts_of
from presslake.llm.training import held_out, labelled_sample
from presslake.session import read

WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 2, 16, 6
#: Positions of a block; a chunk is two blocks.
BLOCK = 64
PER_CLASS, EPOCHS, BATCH = 1200, 14, 32
THRESHOLD = 0.3
#: Bytes whose responses are computed at a time.
SPAN = BLOCK * STRIDE * 32


def padded(data: bytes) -> np.ndarray:
    """Bytes with zeros at the end, up to whole blocks and the last filter's reach."""
    blocks = max(1, -(-len(data) // (BLOCK * STRIDE)))
    out = np.zeros(blocks * BLOCK * STRIDE + WIDTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def block_responses(tables: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(blocks, BLOCK, FILTERS): responses of all filters over ``raw``, whose length is whole blocks plus WIDTH."""
    n = (len(raw) - WIDTH) // STRIDE
    out = tables[0].take(raw[: n * STRIDE : STRIDE], axis=0)
    for k in range(1, WIDTH):
        out += tables[k].take(raw[k : k + n * STRIDE : STRIDE], axis=0)
    return out.reshape(-1, BLOCK, out.shape[1])


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def tables(self) -> np.ndarray:
        t = np.einsum("be,kef->kbf", self.p["embed"], self.p["filters"])
        t[0] += self.p["bias"]
        return np.ascontiguousarray(t, np.float32)

    def score(self, data: bytes, tables: np.ndarray) -> float:
        """Probability of label 1, over the whole of ``data``."""
        raw = padded(data)
        tops = []
        for a in range(0, len(raw) - WIDTH, SPAN):
            tops.append(block_responses(tables, raw[a : a + SPAN + WIDTH]).max(1))
        h = self.pooled(np.concatenate(tops))[0]
        z = float(h @ self.p["out"] + self.p["last"][0])
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

    @staticmethod
    def pooled(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document features of block maxima (blocks, FILTERS), and the chunks' values before the rectifier."""
        chunks = np.maximum(tops[:-1], tops[1:]) if len(tops) > 1 else tops
        lit = np.maximum(chunks, 0)
        return np.concatenate([lit.mean(0), lit.max(0)]), chunks

    def gradients(self, raws: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        tables = self.tables()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_tables = np.zeros((WIDTH, 256 * FILTERS), np.float64)
        f = np.arange(FILTERS)
        for raw, target, w in zip(raws, y, weight):
            responses = block_responses(tables, raw)
            where = responses.argmax(1)
            tops = np.take_along_axis(responses, where[:, None, :], 1)[:, 0]
            h, chunks = self.pooled(tops)
            z = h @ self.p["out"] + self.p["last"][0]
            d = w * (1 / (1 + np.exp(-z)) - target)
            g["out"] += d * h
            g["last"] += d
            dh = d * self.p["out"]
            d_chunk = np.tile(dh[:FILTERS] / len(chunks), (len(chunks), 1))
            d_chunk[chunks.argmax(0), f] += dh[FILTERS:]
            d_chunk[chunks <= 0] = 0
            d_top = np.zeros_like(tops)
            if len(tops) > 1:
                left = tops[:-1] >= tops[1:]
                d_top[:-1] += d_chunk * left
                d_top[1:] += d_chunk * ~left
            else:
                d_top += d_chunk
            blocks, cols = np.nonzero(d_top)
            at = (blocks * BLOCK + where[blocks, cols]) * STRIDE
            value = d_top[blocks, cols]
            for k in range(WIDTH):
                d_tables[k] += np.bincount(raw[at + k].astype(np.int64) * FILTERS + cols, weights=value, minlength=256 * FILTERS)
        d_tables = d_tables.reshape(WIDTH, 256, FILTERS)
        g["embed"] += np.einsum("kbf,kef->be", d_tables, self.p["filters"]).astype(np.float32)
        g["embed"][0] = 0
        g["filters"] += np.einsum("be,kbf->kef", self.p["embed"], d_tables).astype(np.float32)
        g["bias"] += d_tables[0].sum(0).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        raws = [padded(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(raws))
            now = rate * (1 - epoch / epochs) + rate / 20
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                step += 1
                for k, d in self.gradients([raws[i] for i in own], y[own], weight[own] / len(own)).items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.99 * s[k] + 0.01 * d * d
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """A network, or the share of label 1 where one class has no documents."""

    texts, counts = labelled_sample(docs, labels, "quality", per_class)
    rows = sorted(texts.collect())  # 2 * per_class rows at most
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    share = np.array([counts[0], counts[1]]) / sum(counts.values())
    weight = (share / np.bincount(y) * len(y))[y]
    return Network().fit([r["text"].encode("utf-8", "surrogatepass") for r in rows], y, weight)


def score(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; one narrow pass."""
    docs = docs.drop("score", "predicted")  # columns of these names give way
    columns = docs.columns

    def start():
        tables = None if isinstance(model, float) else model.tables()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            scores = [model if tables is None else model.score(t.encode("utf-8", "surrogatepass"), tables) for t in texts]
            return pa.record_batch([*(batch.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*columns, "score", "predicted"])

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, f"{fields}, score double, predicted int", start)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
