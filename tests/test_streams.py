"""Streams with state against batch results, across restarts."""

import time

import numpy as np
import pytest

from orbitlake.streaming import recursive, sink

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def runs(n_runs=5, steps=24):
    rng = np.random.default_rng(1)
    rows = []
    for r in range(n_runs):
        x = rng.normal(size=2)
        for t in range(steps + r):
            rows.append((f"r{r}", t, float(x[0]), None if t == 7 and r == 2 else float(x[1])))
            x = np.array([[0.9, -0.2], [0.1, 0.7]]) @ x + rng.normal(size=2) * 0.1
    return rows


SCHEMA = "run string, t int, u double, v double"


def test_recurrence_is_least_squares():
    """With forgetting 1 and a large start the recurrence ends at the least-squares map."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    made = recursive.Recurrence(3, start=1e9)
    for row in x:
        made.move(row)
    best = np.linalg.lstsq(x[:-1], x[1:], rcond=None)[0].T
    assert np.allclose(made.a, best, atol=1e-5)


def test_batch_rows_of_any_order(spark):
    rows = runs()
    df = spark.createDataFrame([*rows, rows[3], ("r0", None, 1.0, 1.0), (None, 0, 1.0, 2.0)], SCHEMA).repartition(4)
    got = {r["run"]: r for r in recursive.coefficients(df, "run", ["u", "v"]).collect()}
    assert got[None]["steps"] == 1 and got[None]["a00"] == 0.0 and got["r4"]["steps"] == 28
    one = recursive.Recurrence(2)
    for r in [r for r in rows if r[0] == "r2"]:
        one.move(np.array([np.nan if v is None else v for v in r[2:]]))
    assert np.allclose([got["r2"][f"a{i}{j}"] for i in (0, 1) for j in (0, 1)], one.a.ravel())
    assert recursive.coefficients(df.limit(0), "run", ["u", "v"]).count() == 0


def test_stream_agrees_with_batch_across_a_restart(rocks, tmp_path):
    """Steps arrive in three files; the query is stopped between them and started anew from its checkpoint."""
    spark, rows = rocks, runs()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    latest = {}
    for part in range(3):
        mine = [r for r in rows if part * 9 <= r[1] < (part + 1) * 9 or (part == 2 and r[1] >= 27)]
        again = [r for r in rows if r[1] == part * 9 - 1]  # steps that come twice
        spark.createDataFrame(mine + again, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        made = recursive.streaming_coefficients(stream, "run", ["u", "v"])
        query = made.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()  # noqa: B023
        query.awaitTermination()
        for n in range(3):
            try:
                found = spark.read.parquet(f"{out}/{n}").collect()
            except Exception:  # no such batch yet
                continue
            latest |= {r["run"]: r for r in found}
    whole = {r["run"]: r for r in recursive.coefficients(spark.createDataFrame(rows, SCHEMA), "run", ["u", "v"]).collect()}
    assert set(latest) == set(whole)
    for run, r in whole.items():
        assert latest[run]["steps"] == r["steps"]
        assert np.allclose([latest[run][c] for c in r.asDict() if c.startswith("a")], [r[c] for c in r.asDict() if c.startswith("a")])


def test_idle_runs_are_given_up(rocks, tmp_path):
    """A run that comes back after its timer starts anew; one with news in between goes on."""
    spark, source = rocks, str(tmp_path / "in")
    arrive = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arrive([("a", 0, 1.0, 2.0), ("a", 1, 2.0, 3.0)])
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen.setdefault(r["run"], []).append(r["steps"])

    made = recursive.streaming_coefficients(spark.readStream.schema(SCHEMA).parquet(source), "run", ["u", "v"], idle_ms=1500)
    query = made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()

    def until(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.2)
        assert done(), seen

    try:
        until(lambda: seen.get("a") == [2])
        time.sleep(5)
        arrive([("a", 2, 1.0, 2.0)])
        until(lambda: len(seen["a"]) == 2)
    finally:
        query.stop()
    assert seen["a"] == [2, 1]


def test_flushed_runs_are_there_once(spark, tmp_path):
    """A batch that runs again after its commit, and one whose task left files behind, add nothing; files are cut by rows."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run_id long, v double"
    arrive = lambda lo, hi: spark.range(lo, hi, 1, 2).selectExpr("id AS run_id", "id / 7.0D AS v").write.mode("append").parquet(source)

    def drain():
        query = sink.flush_runs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), out, state, rows=40, once=True)
        query.awaitTermination()

    arrive(0, 300)
    drain()
    assert sorted(r["run_id"] for r in sink.committed_runs(spark, out).collect()) == list(range(300))
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "out" / "data").glob("*.parquet")]
    assert max(sizes) == 40 and len(sizes) >= 8
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()  # as if killed between the sink's commit and the query's own
    for crc in (tmp_path / "state" / "commits").glob(f".{newest.name}.crc"):
        crc.unlink()
    (tmp_path / "out" / "data" / "run-left.parquet").write_bytes(next((tmp_path / "out" / "data").glob("*.parquet")).read_bytes())
    arrive(300, 350)
    drain()
    assert sorted(r["run_id"] for r in sink.committed_runs(spark, out).collect()) == list(range(350))
