"""Tables as SQL text, in batches that are whole or not there at all (SNK-14): a Spark data source that is written to.

Every task writes its statements to a file of its own, ``batch`` of them to a transaction; the driver
gives the files their names only when all tasks have ended, and a write that fails takes them away, so
that neither a lost executor nor a task that is run twice leaves half a batch or one twice. A task that
was still at work when its job failed can leave a folder ``_passing-...``, which nothing reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from presslake.session import by_value

#: Statements of a transaction.
BATCH = 50
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class Written(WriterCommitMessage):
    """A task's file, still under its passing name, and what it holds."""

    file: str
    name: str
    rows: int
    batches: int


def literal(value: object) -> str:
    """A value as SQL text; lists, maps and structs are text like any other."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return "NULL"
    if isinstance(value, int | float | Decimal):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return f"X'{bytes(value).hex()}'"
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)
    return "'" + text.replace("'", "''").replace("\x00", "") + "'"


def statement(table: str, columns: list[str], row: tuple) -> str:
    return f"INSERT OR REPLACE INTO {table} ({', '.join(columns)}) VALUES ({', '.join(map(literal, row))});"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


class DumpWriter(DataSourceWriter):
    def __init__(self, path: str, table: str, columns: list[str], batch: int, overwrite: bool):
        for name in (table, *columns):
            if not NAME.fullmatch(name):
                raise ValueError(f"{name} is no plain SQL name")
        self.path, self.table, self.columns, self.batch, self.overwrite = path, table, columns, batch, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        system, root = _place(self.path)
        system.create_dir(f"{root}/_passing-{self.job}", recursive=True)
        name = f"{self.table}-{context.partitionId():06d}-{self.job[:8]}.sql"
        file = f"{root}/_passing-{self.job}/{name}.{context.taskAttemptId()}"
        rows = batches = 0
        held: list[str] = []
        with system.open_output_stream(file, compression=None) as out:

            def flush() -> None:
                nonlocal batches
                if held:
                    out.write(("BEGIN;\n" + "\n".join(held) + "\nCOMMIT;\n").encode())
                    batches += 1
                    held.clear()

            for row in iterator:
                held.append(statement(self.table, self.columns, tuple(row)))
                rows += 1
                if len(held) == self.batch:
                    flush()
            flush()
        return Written(file, name, rows, batches)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith(f"{self.table}-") and f.base_name.endswith(".sql"):
                    system.delete_file(f.path)
        for message in messages:
            if message is not None and message.rows:
                system.move(message.file, f"{root}/{message.name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _place(self.path)
        passing = f"{root}/_passing-{self.job}"
        if system.get_file_info(passing).type == fs.FileType.Directory:
            system.delete_dir(passing)


class SqlDump(DataSource):
    """df.write.format("sqldump").option("table", name).mode("append").save(path); mode overwrite replaces the table's files."""

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DumpWriter(self.options["path"], self.options["table"], schema.names, int(self.options.get("batch", BATCH)), overwrite)


def register(spark: SparkSession) -> None:
    by_value(__name__)
    spark.dataSource.register(SqlDump)
