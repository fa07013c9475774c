"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one engine per Python worker, which takes one Spark partition at a time.

Each task cuts its texts into words by the vocabulary's pattern and hands the distinct words that it
hasn't met to DuckDB. There a word is rows (word, place, left, right, next place), one per adjacent
pair of tokens. The recursive query joins these rows with the merge table, picks every word's
minimum rank (leftmost first), contracts that pair, and goes on until no row of a word can merge.
Words of more than LONG bytes are cut into spans, which are words of their own in the recursive query;
neighbouring spans are then joined, two by two: the tokens about a seam are contracted again from their
bytes, and where the first and the last of them come out as before, all neighbouring tokens stand as
the whole word's contraction leaves them (a sequence of tokens is a word's encoding if each two
neighbours are that of their bytes); else more tokens about the seam are taken, up to both spans. So
time and memory grow with a word's length and not with its square. What is contracted about a seam may
itself be long: such rows are kept for the live generation only, and each turn contracts all pairs of a
word's minimum rank that don't overlap, from the left, up to the first whose contraction lets a lower
rank in, so that the result is that of one pair at a time.
The token rows, joined with the vocabulary's bytes and sorted by word and place, then give each word's ids and the
decoded word, as runs of one sorted result; a word that is a token needs neither. A text's ids are its words' ids in order; so are its decoded bytes.

The engine holds ENGINE_MEMORY and spills nothing: what it takes at a time is bounded by ROWS and LONG_BYTES.

Defined cases: a null text counts as empty; an empty text has 0 tokens and the digest of nothing; a
text of one word of any length is encoded whole; repeated rows give a row each; a null doc_id stays
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from presslake.llm.common import documents, map_batches, texts_of
from presslake.llm.common import vocabulary as shipped

#: Code points of the Unicode property White_Space, which the pattern's \s stands for (fixed values).
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
#: Words whose ids a task remembers before it starts anew, and words in one recursive query.
MEMORY, ROUND = 400_000, 50_000
#: Bytes of ids and decoded words that a task remembers, longest word that the recursive query takes, its rows, and bytes of longer words at a time.
MEMORY_BYTES, LONG, ROWS, LONG_BYTES = 48 << 20, 64, 1 << 21, 1 << 19
#: Bytes of a long word's spans, and tokens on each side of a seam that are first contracted again.
SPAN, SEAM = 48, 6
ENGINE_MEMORY = "400MB"
#: What is known of a word.
TEXT, SIZE, DECODED = map(itemgetter, range(3))

_tables: dict[str, tuple[list[bytes], pa.Table]] = {}

#: One row per adjacent pair of a word's tokens; a turn contracts the leftmost minimum-rank pair of every word.
CONTRACT = """
CREATE OR REPLACE TEMP TABLE generation AS
WITH RECURSIVE pair AS (
    SELECT p.word, p.place, p.l, p.r, p.place + 1 AS next, m.merged, 0 AS turn
    FROM pairs p LEFT JOIN merges m ON m.l = p.l AND m.r = p.r
  UNION ALL
    SELECT n.word, n.place, n.l, n.r, n.next, m.merged, n.turn
    FROM (
        SELECT p.word, p.next, p.turn + 1 AS turn,
               CASE WHEN p.place = b.next THEN b.place ELSE p.place END AS place,
               CASE WHEN p.place = b.next THEN b.merged ELSE p.l END AS l,
               CASE WHEN p.next = b.place THEN b.merged ELSE p.r END AS r
        FROM pair p JOIN (
            SELECT word, (first_pair >> 32)::INTEGER AS merged, (first_pair & 4294967295)::INTEGER AS place, next
            FROM (SELECT word, min((merged::BIGINT << 32) | place) AS first_pair, arg_min(next, (merged::BIGINT << 32) | place) AS next
                  FROM pair WHERE merged IS NOT NULL GROUP BY word)
        ) b USING (word)
        WHERE p.place <> b.place
    ) n LEFT JOIN merges m ON m.l = n.l AND m.r = n.r
)
SELECT word, place, l, r, next, turn FROM pair
"""
#: Long words: their live pairs, the pairs that a turn contracts, and the live pairs after it.
LIVE = "CREATE OR REPLACE TEMP TABLE live AS SELECT p.word, p.place, p.l, p.r, p.place + 1 AS next, m.merged FROM pairs p LEFT JOIN merges m ON m.l = p.l AND m.r = p.r"
CHOOSE = """
CREATE OR REPLACE TEMP TABLE chosen AS
WITH candidate AS (
    SELECT p.* FROM live p JOIN (SELECT word, min(merged) AS merged FROM live GROUP BY word) b ON b.word = p.word AND b.merged = p.merged
), marked AS (
    SELECT *, (lag(next) OVER (PARTITION BY word ORDER BY place) IS DISTINCT FROM place)::INTEGER AS starts FROM candidate
), island AS (
    SELECT *, sum(starts) OVER (PARTITION BY word ORDER BY place) AS island FROM marked
), apart AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, island ORDER BY place) AS k FROM island) WHERE k % 2 = 1
), beside AS (
    SELECT a.word, a.place, a.merged, a.merged AS l, p.r FROM apart a JOIN live p ON p.word = a.word AND p.place = a.next
    UNION ALL SELECT a.word, a.place, a.merged, p.l, a.merged FROM apart a JOIN live p ON p.word = a.word AND p.next = a.place
    UNION ALL SELECT word, place, merged, merged, merged FROM apart
), first_lower AS (
    SELECT b.word, min(b.place) AS place FROM beside b JOIN merges m ON m.l = b.l AND m.r = b.r WHERE m.merged < b.merged GROUP BY b.word
)
SELECT a.word, a.place, a.next, a.merged FROM apart a LEFT JOIN first_lower f ON f.word = a.word WHERE f.place IS NULL OR a.place <= f.place
"""
TURN = """
CREATE OR REPLACE TEMP TABLE turned AS
WITH moved AS (
    SELECT p.word, coalesce(x.place, p.place) AS place, coalesce(x.merged, p.l) AS l, coalesce(y.merged, p.r) AS r, p.next, p.merged,
           x.merged IS NOT NULL OR y.merged IS NOT NULL AS changed
    FROM live p LEFT JOIN chosen x ON x.word = p.word AND x.next = p.place LEFT JOIN chosen y ON y.word = p.word AND y.place = p.next
    WHERE NOT EXISTS (FROM chosen c WHERE c.word = p.word AND c.place = p.place)
)
SELECT word, place, l, r, next, merged FROM moved WHERE NOT changed
UNION ALL
SELECT n.word, n.place, n.l, n.r, n.next, m.merged FROM moved n LEFT JOIN merges m ON m.l = n.l AND m.r = n.r WHERE n.changed
"""
LONG_TOKENS = "CREATE OR REPLACE TEMP TABLE token AS SELECT word, 0 AS place, l AS id FROM live WHERE place = 0 UNION ALL SELECT word, next, r FROM live"
#: A word's tokens: the left of its first pair and the right of every pair, in its last generation.
TOKENS = """
CREATE OR REPLACE TEMP TABLE token AS
WITH fixpoint AS (SELECT g.* FROM generation g JOIN (SELECT word, max(turn) AS turn FROM generation GROUP BY word) USING (word, turn))
SELECT word, 0 AS place, l AS id FROM fixpoint WHERE place = 0 UNION ALL SELECT word, next, r FROM fixpoint UNION ALL SELECT word, 0, id FROM single
"""
#: All words' tokens in order, with what they stand for: one sort, where an ordered aggregate would sort every word.
DECODE = "SELECT word, v.text, v.bytes FROM token JOIN vocab v USING (id) ORDER BY word, place"


def load_ranks(path: str) -> tuple[list[bytes], pa.Table]:
    """Token bytes by id, and the merge table (l, r, merged): every cut of a token into two tokens."""
    if path not in _tables:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        _tables[path] = by_id, pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})
    return _tables[path]


def splitter(pattern: str):
    """findall() of the vocabulary's pattern, with \\s as Unicode's White_Space."""
    import regex

    inside = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(inside.replace(r"\s", f"[{WHITE_SPACE}]")).findall


def parts(items: list[int], cost, most: int, many: int) -> Iterator[list[int]]:
    """Runs of items of bounded cost and number."""
    part, size = [], 0
    for i in items:
        if part and (size + cost(i) > most or len(part) == many):
            yield part
            part, size = [], 0
        part.append(i)
        size += cost(i)
    if part:
        yield part


class Codec:
    """Word -> (ids as text, number of ids, decoded bytes), through DuckDB for words not met yet."""

    def __init__(self, vocabulary: str, pattern: str):
        import duckdb

        self.bytes, merges = load_ranks(vocabulary)
        self.of_byte = {self.bytes[i][0]: i for i in range(len(self.bytes)) if len(self.bytes[i]) == 1}
        self.whole = {token: i for i, token in enumerate(self.bytes) if token}
        self.words = splitter(pattern)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": ENGINE_MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS FROM merges_in")
        vocab = pa.table({"id": pa.array(range(len(self.bytes)), pa.int32()), "text": pa.array(map(str, range(len(self.bytes)))), "bytes": pa.array(self.bytes, pa.binary())})
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE vocab AS FROM vocab_in")

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMORY or self.held > MEMORY_BYTES:
            self.known.clear()
            self.held = 0
            new = list(words)
        raw = [w.encode() for w in new]
        whole, short, long = [], [], []
        for i, b in enumerate(raw):
            (whole if b in self.whole else short if len(b) <= LONG else long).append(i)
        for i in whole:  # a word that is a token is that token
            self.known[new[i]] = (str(self.whole[raw[i]]), 1, raw[i])
            self.held += len(self.known[new[i]][0]) + len(raw[i])
        for part in parts(short, lambda i: len(raw[i]) ** 2 // 2, ROWS, ROUND):
            self._contract([raw[i] for i in part])
            self._keep([new[i] for i in part])
        for part in parts(long, lambda i: len(raw[i]), LONG_BYTES, ROUND):
            self._keep([new[i] for i in part], self.joined([raw[i] for i in part]))

    def _contract(self, raw: list[bytes], long: bool = False) -> None:
        """Fills the table token with the contraction of every word."""
        import numpy as np

        table = np.zeros(256, np.int32)
        table[list(self.of_byte)] = list(self.of_byte.values())
        flat = table[np.frombuffer(b"".join(raw), np.uint8)]
        size = np.array([len(b) for b in raw], np.int64)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        first = np.cumsum(size) - size
        place = (np.arange(len(flat)) - np.repeat(first, size)).astype(np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.array([], int)
        one = np.flatnonzero(size == 1)
        db = self.db
        db.register("pairs", pa.table({"word": word[inner], "place": place[inner], "l": flat[inner], "r": flat[inner + 1]}))
        db.register("single", pa.table({"word": one.astype(np.int32), "id": flat[first[one]]}))
        if long:
            db.execute(LIVE)
            while True:
                db.execute(CHOOSE)
                if not db.execute("SELECT count(*) FROM chosen").fetchone()[0]:
                    break
                db.execute(TURN)
                db.execute("DROP TABLE live")
                db.execute("ALTER TABLE turned RENAME TO live")
            db.execute(LONG_TOKENS)
        else:
            db.execute(CONTRACT)
            db.execute(TOKENS)
        db.unregister("pairs")
        db.unregister("single")

    def contracted(self, raw: list[bytes]) -> list[list[int]]:
        """The tokens of every word."""
        out: list[list[int]] = [[]] * len(raw)
        short, long = [i for i, b in enumerate(raw) if len(b) <= LONG], [i for i, b in enumerate(raw) if len(b) > LONG]
        for group, most, cost in ((short, ROWS, lambda i: len(raw[i]) ** 2 // 2), (long, LONG_BYTES, lambda i: len(raw[i]))):
            for part in parts(group, cost, most, ROUND):
                self._contract([raw[i] for i in part], group is long)
                for i, ids in self.db.execute("SELECT word, list(id ORDER BY place) FROM token GROUP BY word").fetchall():
                    out[part[i]] = ids
        return out

    def joined(self, raw: list[bytes]) -> list[list[int]]:
        """The tokens of long words, from their spans."""
        cut = [[b[a : a + SPAN] for a in range(0, len(b), SPAN)] for b in raw]
        found = iter(self.contracted([span for spans in cut for span in spans]))
        own = [[next(found) for _ in spans] for spans in cut]
        text = lambda ids: b"".join(self.bytes[i] for i in ids)
        while any(len(spans) > 1 for spans in own):
            seams = [(w, k) for w, spans in enumerate(own) for k in range(0, len(spans) - 1, 2)]
            done: dict[tuple[int, int], list[int]] = {}
            m = SEAM
            while seams:
                sides = [(own[w][k][-m:], own[w][k + 1][:m]) for w, k in seams]
                again = self.contracted([text(a) + text(b) for a, b in sides])
                left = []
                for (w, k), (a, b), ids in zip(seams, sides, again):
                    one, other = own[w][k], own[w][k + 1]
                    if (len(a) == len(one) or ids[0] == a[0]) and (len(b) == len(other) or ids[-1] == b[-1]):
                        done[w, k] = one[: len(one) - len(a)] + ids + other[len(b) :]
                    else:
                        left.append((w, k))
                seams, m = left, 2 * m
            own = [[done[w, k] if (w, k) in done else spans[k] for k in range(0, len(spans), 2)] for w, spans in enumerate(own)]
        return [spans[0] for spans in own]

    def _keep(self, words: list[str], ids: list[list[int]] | None = None) -> None:
        """Remembers the words of the table token, or of ``ids``, with their ids and decoded bytes."""
        import numpy as np
        import pyarrow.compute as pc

        if ids is not None:
            size = np.array([len(i) for i in ids], np.int64)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("tokens_in", pa.table({"word": np.repeat(np.arange(len(ids), dtype=np.int32), size), "place": place.astype(np.int32), "id": np.concatenate([np.array(i, np.int32) for i in ids])}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE token AS FROM tokens_in")
            self.db.unregister("tokens_in")
        out = self.db.sql(DECODE).to_arrow_table()
        word = out.column("word").to_numpy()
        first = np.flatnonzero(np.diff(word, prepend=-1))
        ends = np.append(first, len(word))
        runs = lambda c, by: pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), out.column(c).combine_chunks()), by).to_pylist()
        for i, text, n, decoded in zip(word[first].tolist(), runs("text", " "), np.diff(ends).tolist(), runs("bytes", b"")):
            self.known[words[i]] = (text, n, decoded)
            self.held += len(text) + len(decoded)


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(vocabulary: str, pattern: str) -> Codec:
    """The Python worker's engine: later tasks of a worker find its tables and words."""
    if (vocabulary, pattern) not in _codecs:
        _codecs[vocabulary, pattern] = Codec(vocabulary, pattern)
    return _codecs[vocabulary, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every row; with ``ids`` also the ids and the decoded text.

    One narrow pass: texts aren't shuffled, and what a task holds is bounded by a batch and MEMORY words.
    """
    place = shipped(docs.sparkSession, vocabulary)

    def start():
        codec = codec_of(place(), pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [codec.words(t) for t in texts_of(batch)]
            codec.learn(set().union(*words))
            rows = []
            for own in words:
                found = list(map(codec.known.__getitem__, own))
                rows.append((" ".join(map(TEXT, found)), sum(map(SIZE, found)), b"".join(map(DECODED, found))))
            out = [batch.column("doc_id"), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in rows]), pa.array([hashlib.sha256(d).hexdigest() for _, _, d in rows])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out += [pa.array([list(map(int, t.split())) for t, _, _ in rows], pa.list_(pa.int32())), pa.array([d.decode() for _, _, d in rows])]
                names += ["ids", "decoded"]
            return pa.record_batch(out, names=names)

        return step

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return map_batches(docs.select("doc_id", "text"), schema, start)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
