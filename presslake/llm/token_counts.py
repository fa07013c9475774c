"""Token counts by heap-and-linked-list pair merging, without emitting identifiers.

A text is normalised as the vocabulary's model asks (spaces become U+2581, one is put in front) and
cut where no merge can reach across: before each run of U+2581. A piece starts as a linked list of
characters; a heap holds its adjacent pairs by rank, then place. The lowest pair is popped and merged
until none is left. The count is the initial symbols minus the merges, plus the bytes that a
character outside the vocabulary is spelled with, less one for each.

Defined cases: a null text counts as empty; an empty text has 0 tokens; repeated rows give a row
each; a null doc_id stays null; an empty table gives no rows; other columns are ignored, whatever they
are called.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from presslake.llm.common import documents, map_batches, texts_of
from presslake.llm.common import vocabulary as shipped

SPACE = "▁"
#: Tokens beyond which a document is over the context limit.
LIMIT = 4096
#: Pieces whose counts a worker remembers before it starts anew.
MEMORY = 600_000
NORMAL, BYTE = 1, 6

_loaded: dict[str, dict[str, int]] = {}
_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The vocabulary's counter, which all tasks of a worker share."""
    if path not in _counters:
        _counters[path] = Counter(load_ranks(path))
    return _counters[path]


def load_ranks(path: str) -> dict[str, int]:
    """Piece -> merge rank (0 merges first) of a sentencepiece BPE model with byte fallback."""
    if path not in _loaded:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("the model isn't BPE with byte fallback, a leading space and no rewriting")
        pieces = [p for p in proto.pieces if p.type == NORMAL]
        order = sorted(range(len(pieces)), key=lambda i: (-pieces[i].score, i))
        ranks: dict[str, int] = {}
        last, rank = None, -1
        for i in order:  # equal scores share a rank: the leftmost pair then goes first
            rank += pieces[i].score != last
            last = pieces[i].score
            ranks[pieces[i].piece] = rank
        if any(SPACE in p.lstrip(SPACE) for p in ranks):
            raise ValueError("a piece goes on over a space")
        _loaded[path] = ranks
    return _loaded[path]


def merge_count(piece: str, ranks: dict[str, int]) -> int:
    """Tokens of one piece. The heap's numbers are rank * n + place, so the lowest rank goes first, the leftmost of equals."""
    n = len(piece)
    if n == 1:
        return 1 if piece in ranks else len(piece.encode())
    get, symbol = ranks.get, list(piece)
    heap = [rank * n + i for i, rank in enumerate(map(get, map(add, piece, piece[1:]))) if rank is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    gone = 0
    while heap:
        rank, i = divmod(heappop(heap), n)
        left, j = symbol[i], after[i]
        if not left or j >= n or get(left := left + symbol[j]) != rank:
            continue  # one side has been merged since
        symbol[i], symbol[j] = left, ""
        gone += 1
        k = after[i] = after[j]
        before[k] = i
        if k < n and (rank := get(left + symbol[k])) is not None:
            heappush(heap, rank * n + i)
        if (h := before[i]) >= 0 and (rank := get(symbol[h] + left)) is not None:
            heappush(heap, rank * n + h)
    if all(map(ranks.__contains__, piece)):
        return n - gone
    return n - gone + sum(len(s.encode()) - 1 for s in symbol if s and s not in ranks)


class Counter(dict):
    """Unit -> count, filled as units are met; units are cut further between characters that no piece holds side by side."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks
        #: Neighbours in some piece: merges never reach over any others.
        self.beside = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}

    def __missing__(self, unit: str) -> int:
        beside, first, count = self.beside, 0, 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in beside:
                count += self.part(unit[first:i])
                first = i
        count += self.part(unit[first:])
        if len(unit) < 200:
            self[unit] = count
        return count

    def part(self, unit: str) -> int:
        """Tokens of a unit in which all neighbours stand in some piece."""
        if (count := self.get(unit)) is None:
            count = merge_count(unit, self.ranks)
            if len(unit) < 200:
                self[unit] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > MEMORY:
            self.clear()
        return sum(map(self.__getitem__, UNITS(SPACE + text.replace(" ", SPACE))))


UNITS = re.compile(f"{SPACE}+[^{SPACE}]*").findall


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one narrow pass, nothing is shuffled."""
    place = shipped(docs.sparkSession, vocabulary)

    def start():
        counter = counter_of(place())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            tokens = [counter.count(t) for t in texts]
            return pa.record_batch([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
