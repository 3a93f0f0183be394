"""A sink for finished runs that flushes by rows or time and holds every row once.

Tasks write Parquet files and say which in their commit messages.  A batch
counts once its number has a file in ``_commits`` that lists them; a batch that
runs again after that leaves nothing.  Files that no commit lists are what a
killed task has left, and readers do not see them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

#: Rows, and seconds, after which a task's rows are flushed to a file: fixed values of the run hub.
FLUSH_ROWS, FLUSH_SECONDS = 10_000, 60.0


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """The files of a task."""

    files: list[str] = field(default_factory=list)
    rows: int = 0


class RunWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, rows: int, seconds: float):
        self.path, self.rows, self.seconds = path.rstrip("/"), rows, seconds

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _store(self.path)
        files.create_dir(f"{base}/data")
        made, waiting, held, began = Written(), [], 0, time.monotonic()

        def flush() -> None:
            name = f"run-{uuid.uuid4().hex}.parquet"
            with files.open_output_stream(f"{base}/data/{name}") as out:
                pa.parquet.write_table(pa.Table.from_batches(waiting), out)
            made.files.append(name)
            made.rows += held

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - held)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                held += part.num_rows
                if held >= self.rows or time.monotonic() - began >= self.seconds:
                    flush()
                    waiting, held, began = [], 0, time.monotonic()
        if held:
            flush()
        return made

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, base = _store(self.path)
        files.create_dir(f"{base}/_commits")
        target = f"{base}/_commits/{batchId}.json"
        if files.get_file_info(target).type != pa.fs.FileType.NotFound:  # the batch has been committed before
            self.abort(messages, batchId)
            return
        lines = "".join(json.dumps({"batch": batchId, "file": name}) + "\n" for m in messages if m for name in m.files)
        waiting = f"{base}/_commits/.{batchId}-{uuid.uuid4().hex}"
        with files.open_output_stream(waiting) as out:
            out.write(lines.encode())
        files.move(waiting, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, base = _store(self.path)
        for name in [n for m in messages if m for n in m.files]:
            files.delete_file(f"{base}/data/{name}")


class RunSink(DataSource):
    """``format("orbitlake_runs")`` with the options ``path``, ``rows`` and ``seconds``; the path must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "orbitlake_runs"

    def streamWriter(self, schema, overwrite: bool) -> RunWriter:
        return RunWriter(self.options["path"], int(self.options.get("rows", FLUSH_ROWS)), float(self.options.get("seconds", FLUSH_SECONDS)))


def flush_runs(runs: DataFrame, path: str, checkpoint: str, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS, once: bool = False) -> StreamingQuery:
    """Start to write a stream of runs: a batch every ``seconds`` (or, with ``once``, what is there now), files of at most ``rows`` rows."""
    runs.sparkSession.dataSource.register(RunSink)
    writer = runs.writeStream.format("orbitlake_runs").option("path", path).option("rows", rows).option("seconds", seconds).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    listed = spark.read.schema("batch long, file string").json(f"{path}/_commits/*.json")
    rows = spark.read.parquet(f"{path}/data")
    named = rows.select("*", F.col("_metadata.file_name").alias("__file"))
    return named.join(listed.select(F.col("file").alias("__file")), "__file", "left_semi").drop("__file")
