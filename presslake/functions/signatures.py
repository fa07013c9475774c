"""MinHash signatures of texts, as one aggregation over their shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions.columns import normalized
from presslake.session import ship

#: Slots of a signature, the modulus of its hashes, seed and factor of its coefficients (fixed values).
SLOTS, PRIME, SEED, FACTOR = 64, 2147483647, 42, 16807


def coefficients(slots: int = SLOTS) -> list[tuple[int, int]]:
    """(a, b) of every slot's hash a * h + b, from one sequence of numbers."""
    numbers, x = [], SEED
    for _ in range(2 * slots):
        x = x * FACTOR % PRIME
        numbers.append(x % 1_000_000)
    return [(1 + a, b) for a, b in zip(numbers[::2], numbers[1::2])]


def long_words(text: Column) -> Column:
    """Words of two letters or more of normalized text, with one space between."""
    return F.array_join(F.filter(F.split(normalized(text), " "), lambda w: F.length(w) > 1), " ")


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1), modulo 2^32."""
    out = np.full(n, base, np.uint32)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


def pair_hashes(text: str) -> np.ndarray:
    """Hashes of neighbouring words, or of a single one: the absolute value of the signed 32-bit number 5381 * 33^n + ... of n code points.

    33 has an inverse modulo 2^32, so that sums over the whole text give the number of any part of it.
    """
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(points * _powers(pow(33, -1, 1 << 32), len(points)), dtype=np.uint32)])
    powers = _powers(33, len(points) + 1)
    gaps = np.flatnonzero(points == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(points)]])
    if len(starts) > 1:
        starts, ends = starts[:-1], ends[1:]
    low = (np.uint32(5381) * powers[ends - starts] + powers[ends - 1] * (sums[ends] - sums[starts])).astype(np.int64)
    return np.minimum(low, (1 << 32) - low)


def signatures(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, signature) of every key's texts (TX-9); null where a key has no word of two letters.

    Hashes and minima of a text are numpy's, over Arrow batches; of a key's texts in one task the minima are put
    together before their shuffle.
    """
    ship(texts.sparkSession)
    names = [f"s{i}" for i in range(SLOTS)]
    own = texts.select(F.col(key), long_words(F.col(text)).alias("words"))
    factors, terms = (np.array(c, np.int64) for c in zip(*coefficients()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full((batch.num_rows, SLOTS), PRIME, np.int64)
            for row, words in enumerate(batch.column("words").to_pylist()):
                hashes = pair_hashes(words or "")
                for part in np.split(hashes, range(4096, len(hashes), 4096)):
                    if len(part):
                        np.minimum(least[row], ((part[:, None] * factors + terms) % PRIME).min(axis=0), out=least[row])
            # no hash is as large as the modulus: such a row has no word
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, pa.int64(), mask=c == PRIME) for c in least.T)], names=[key, *names])

    schema = f"`{key}` {own.schema[key].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}"
    least = own.mapInArrow(run, schema).groupBy(key).agg(*(F.min(n).alias(n) for n in names))
    return least.select(key, F.when(F.col("s0").isNotNull(), F.array(*names)).alias("signature"))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots (TX-10); 0 if sizes differ or there is none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))
