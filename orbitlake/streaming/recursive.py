"""Recursive least squares on streams: the linear map from step to step of every run, kept as state.

The state of a run is its map A, the inverse correlation P, the last step seen
and its values.  A micro-batch brings new steps; each moves A and P once.  What
the stream emits is the run's coefficients after its newest step.  Batch tables
go through the same recurrence, so both give the same coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import EPS

#: Forgetting factor, and the scale of P before the first step.
FORGET, START = 1.0, 1e4


class Recurrence:
    """A and P of one run, moved on step by step; what is no finite number counts as 0."""

    def __init__(self, width: int, forget: float = FORGET, start: float = START):
        self.forget, self.a, self.p = forget, np.zeros((width, width)), np.eye(width) * start
        self.last: np.ndarray | None = None
        self.steps = 0

    def move(self, values: np.ndarray) -> None:
        y = np.where(np.isfinite(values), values, 0.0)
        if self.last is not None:
            x = self.last
            px = self.p @ x
            gain = px / (self.forget + x @ px + EPS)
            self.a = self.a + np.outer(y - self.a @ x, gain)
            self.p = (self.p - np.outer(px, gain)) / self.forget
        self.last, self.steps = y, self.steps + 1


def output_schema(key: str, kind: str, width: int) -> str:
    return ", ".join([f"`{key}` {kind}", "steps long", *[f"a{i}{j} double" for i in range(width) for j in range(width)]])


def _row(key, made: Recurrence) -> list:
    return [key, made.steps, *made.a.ravel()]


def coefficients(obs: DataFrame, key: str, columns: list[str], forget: float = FORGET, start: float = START, order: str = "t") -> DataFrame:
    """(key, steps, a00, a01, ...): per run the map that its steps, in ``order``, lead to.

    ``a_ij`` is the weight of column j at one step in column i at the next.
    Rows without an order are left out, of rows of the same step any one
    counts; a null key is a run of its own.
    """
    kind = dict(obs.dtypes)[key]
    names = [f.split()[0].strip("`") for f in output_schema(key, kind, len(columns)).split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step", kind="stable").drop_duplicates("step")
        made = Recurrence(len(columns), forget, start)
        for values in frame[[f"x{i}" for i in range(len(columns))]].to_numpy(float):
            made.move(values)
        held = frame["run_key"].iloc[0]
        return pd.DataFrame([_row(None if pd.isna(held) else held, made)], columns=names)

    rows = obs.filter(F.col(order).isNotNull()).select(F.col(key).alias("run_key"), F.col(order).cast("long").alias("step"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    return rows.groupBy("run_key").applyInPandas(run, output_schema(key, kind, len(columns)))


class _Keeper(StatefulProcessor):
    """State of the runs of a stream: flat A and P, the last values, the newest step and the number of steps."""

    STATE = T.StructType([T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("last", T.ArrayType(T.DoubleType())), T.StructField("t", T.LongType()), T.StructField("steps", T.LongType())])

    def __init__(self, names: list[str], width: int, forget: float, start: float, idle_ms: int):
        self.names, self.width, self.forget, self.begin, self.idle_ms = names, width, forget, start, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recurrence", self.STATE, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made, newest = Recurrence(self.width, self.forget, self.begin), None
        held = self.state.get() if self.state.exists() else None
        if held is not None:
            made.a, made.p = np.array(held[0]).reshape(self.width, -1), np.array(held[1]).reshape(self.width, -1)
            made.last, newest, made.steps = np.array(held[2]), held[3], held[4]
        frame = pd.concat(list(rows)).sort_values("step", kind="stable").drop_duplicates("step")
        for t, *values in frame[["step", *[f"x{i}" for i in range(self.width)]]].itertuples(index=False):
            if newest is None or t > newest:  # a step that comes again, or too late, moves nothing
                made.move(np.array(values, float))
                newest = t
        self.state.update(([float(v) for v in made.a.ravel()], [float(v) for v in made.p.ravel()], [float(v) for v in made.last], int(newest), int(made.steps)))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame([_row(key[0], made)], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A run without news for ``idle_ms`` is over: its state goes."""
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def streaming_coefficients(obs: DataFrame, key: str, columns: list[str], forget: float = FORGET, start: float = START, order: str = "t", idle_ms: int = 0) -> DataFrame:
    """The same as a stream, in update mode: for every run with news in a micro-batch its coefficients after them.

    Within a run steps must arrive in order between micro-batches; inside one
    they are sorted.  A step that comes again, or after a later one, is left
    out.  With ``idle_ms`` a processing-time timer gives up runs that have had no
    news for so long; Spark then makes batches without end to watch the timers,
    so such a query needs a processing-time trigger, not ``availableNow``.  State lives in RocksDB under the query's checkpoint and
    survives restarts; ``spark.sql.streaming.stateStore.providerClass`` must
    name the RocksDB provider.
    """
    kind = dict(obs.dtypes)[key]
    schema = output_schema(key, kind, len(columns))
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    rows = obs.filter(F.col(order).isNotNull()).select(F.col(key).alias("run_key"), F.col(order).cast("long").alias("step"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    keeper = _Keeper(names, len(columns), forget, start, idle_ms)
    return rows.groupBy("run_key").transformWithStateInPandas(statefulProcessor=keeper, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")
