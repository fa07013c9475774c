"""Scans of rows in order, group by group, with a bounded state carried along: what no window frame can express.

The rows are range-partitioned by group and order, so that a group with a third of all rows is spread
over many tasks. All partitions are scanned at once, each as if nothing came before it. A partition that
begins inside a group should have begun with the state in which the partition before it ended: such
partitions are scanned again from there, and again as long as a state that they were given changes.
A state that only knows the last rows, or the last hours, is soon the same wherever the scan began, so
that one more scan is the rule; at worst a group takes a round per partition.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from presslake.session import checkpoint, ship


def packed(state: object) -> bytes:
    """A pickle without references, so that equal states are equal bytes."""
    out = io.BytesIO()
    pickler = pickle.Pickler(out)
    pickler.fast = True
    pickler.dump(state)
    return out.getvalue()


class Machine(Protocol):
    """A state machine: what it gives for a row depends on that row and its ``state`` alone, which can be pickled."""

    state: object

    def step(self, row: tuple) -> Iterable[tuple]: ...


def ordered_scan(df: DataFrame, group: str, order: list[str], start: Callable[[], Machine], schema: str) -> DataFrame:
    """The rows, of ``schema``, that machines give for the rows of ``df`` in order; ``start()`` makes one for every group.

    ``order`` should tell rows of a group apart. A null group is a group. ``step`` gets a row's values as df has them.
    """
    spark = df.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    base = checkpoint(df).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    base = checkpoint(base.withColumn("part_", F.spark_partition_id()))
    out = spark.createDataFrame([], schema).schema
    marked = StructType().add("part_", "integer").add("begins_", "string").add("ends_", "string").add("state_", "binary")
    arrow = to_arrow_schema(StructType([*out.fields, *marked.fields]))
    place = names.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, and one at the end of every partition: its first and last group, and the state of the last."""
        part = begins = own = machine = carried = None

        def closing() -> tuple:
            return *[None] * len(out), part, begins, repr(own), packed(machine.state)

        for batch in batches:
            columns, rows = [c.to_pylist() for c in batch.columns], []
            for *row, here, given in zip(*columns):
                if here != part:
                    if machine is not None:
                        rows.append(closing())
                    part, machine, carried = here, None, None
                if given is not None:
                    carried = given
                    continue
                if machine is None or row[place] != own:
                    if machine is None:
                        begins = repr(row[place])
                    own, machine = row[place], start()
                    if carried is not None:
                        machine.state, carried = pickle.loads(carried), None
                rows += [(*found, part, None, None, None) for found in machine.step(tuple(row))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if machine is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closing(), arrow)], schema=arrow)

    whole = StructType([*out.fields, *marked.fields])
    given: dict[int, int | None] = {}
    rounds: list[tuple[DataFrame, set[int]]] = [(checkpoint(base.withColumn("state_", F.lit(None).cast("binary")).mapInArrow(run, whole)), set())]
    while True:
        # a row per partition comes to the driver, the states stay where they are
        ends, states = {}, None
        for found, redone in rounds:
            valid = found.filter(~F.col("part_").isin(*redone)) if redone else found
            closing = valid.filter("state_ is not null").select("part_", "begins_", "ends_", "state_")
            states = closing if states is None else states.unionByName(closing)
        for r in states.select("part_", "begins_", "ends_", F.xxhash64("state_").alias("hash")).collect():
            ends[r.part_] = r
        parts = sorted(ends)
        wanted = {b: (a, ends[a].hash) for a, b in zip(parts, parts[1:]) if ends[a].ends_ == ends[b].begins_}
        again = {b: a for b, (a, state) in wanted.items() if given.get(b) != state}
        if not again:
            break
        given |= {b: wanted[b][1] for b in again}
        moves = spark.createDataFrame(list(again.items()), "to_ int, part_ int")
        sent = states.join(F.broadcast(moves), "part_").select(*(F.lit(None).cast(base.schema[c].dataType).alias(c) for c in names), F.col("to_").alias("part_"), "state_")
        rows = base.filter(F.col("part_").isin(*again)).withColumn("state_", F.lit(None).cast("binary"))
        dealt = rows.unionByName(sent).repartition(partitions, "part_").sortWithinPartitions("part_", F.col("state_").isNull(), *keys)
        rounds = [(found, redone | set(again)) for found, redone in rounds]
        rounds.append((checkpoint(dealt.mapInArrow(run, whole)), set()))
    every = None
    for found, redone in rounds:
        valid = (found.filter(~F.col("part_").isin(*redone)) if redone else found).filter("state_ is null").select(*out.names)
        every = valid if every is None else every.unionByName(valid)
    return every
