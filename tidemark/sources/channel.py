"""A message channel as a streaming sink: a Python data source that hands each row to a send function.

Tasks send and note the outcome of every message in a file of their own, under `staged`. A file is
renamed into place when it is whole, so it never shows half. The commit message of a task is the
name of its file; when the batch commits, the driver moves these to `outcomes`, where readers look.

Delivery is at least once. A run that stops after sending leaves whole files under `staged`: what
they say has happened, so `recover`, called before the next run, moves them to `outcomes` too, and
messages noted there as sent are not sent again. Only what a task had sent before its file was
whole goes out twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

MESSAGE = "subscription_id string, cik string, accession string, channel string, target string, subject string, body string"
OUTCOME = "subscription_id string, cik string, accession string, status string, error string"
OUTCOME_ARROW = pa.schema([(c.split()[0], pa.string()) for c in OUTCOME.split(", ")])
#: Outcomes that a task holds before it appends them to its file.
CHUNK = 10_000


def _folder(path: str, name: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(f"{base}/{name}", recursive=True)
    return system, f"{base}/{name}"


@dataclass
class Noted(WriterCommitMessage):
    """What a task has noted: the name of its file."""

    file: str | None


class ChannelWriter(DataSourceStreamWriter):
    def __init__(self, path: str, send: Callable[[dict], None]):
        self.path, self.send = path, send

    def write(self, iterator: Iterator[Row]) -> Noted:
        system, folder = _folder(self.path, "staged")
        name, held, writer, stream = f"{uuid.uuid4().hex}.parquet", [], None, None
        for row in iterator:
            message = row.asDict()
            error = None
            try:
                self.send(message)
            except Exception as problem:  # noqa: BLE001 - any trouble of a channel is an outcome
                error = str(problem)[:500]
            held.append({k: message[k] for k in ("subscription_id", "cik", "accession")} | {"status": "failed" if error is not None else "sent", "error": error})
            if len(held) >= CHUNK or writer is None:
                if writer is None:
                    stream = system.open_output_stream(f"{folder}/_{name}")
                    writer = pq.ParquetWriter(stream, OUTCOME_ARROW)
                if len(held) >= CHUNK:
                    writer.write_table(pa.Table.from_pylist(held, schema=OUTCOME_ARROW))
                    held = []
        if writer is None:
            return Noted(None)
        writer.write_table(pa.Table.from_pylist(held, schema=OUTCOME_ARROW))
        writer.close()
        stream.close()
        system.move(f"{folder}/_{name}", f"{folder}/{name}")
        return Noted(name)

    def commit(self, messages: list[Noted | None], batchId: int) -> None:  # noqa: N803
        publish(self.path, [m.file for m in messages if m is not None and m.file])

    def abort(self, messages: list[Noted | None], batchId: int) -> None:  # noqa: N803
        """Nothing is undone: whole files tell of messages that are out, and recover() finds them."""


def publish(path: str, names: list[str]) -> None:
    """Moves whole files of outcomes to where readers look; a file that is there already stays."""
    system, staged = _folder(path, "staged")
    _, outcomes = _folder(path, "outcomes")
    from pyarrow import fs

    for name in names:
        if system.get_file_info(f"{staged}/{name}").type == fs.FileType.File:
            system.move(f"{staged}/{name}", f"{outcomes}/{name}")


def recover(path: str) -> None:
    """Publishes outcomes that a stopped run left behind. Call it when no run is on."""
    from pyarrow import fs

    system, staged = _folder(path, "staged")
    found = system.get_file_info(fs.FileSelector(staged))
    publish(path, [f.base_name for f in found if not f.base_name.startswith("_")])


def channel(send: Callable[[dict], None], format_name: str = "alert_channel", writer: type[ChannelWriter] = ChannelWriter) -> type[DataSource]:
    """A data source whose sink gives each message, a dict with the columns of MESSAGE, to send in a
    task. Register it with spark.dataSource.register; its option `path` is the folder of the outcomes."""

    class AlertChannel(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return MESSAGE

        def streamWriter(self, schema, overwrite: bool) -> ChannelWriter:  # noqa: N802
            return writer(self.options["path"], send)

    return AlertChannel


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes that are published: a row for each attempt."""
    _folder(path, "outcomes")
    return spark.read.schema(OUTCOME).parquet(f"{path}/outcomes")
