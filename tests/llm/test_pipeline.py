"""The pipeline's stages on planted documents, and the registered queries against their SQL."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbitlake.llm import registry, source_mixing

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """600 clean documents with copies, near copies and a shared passage, and 120 junk ones."""
    rng = np.random.default_rng(9)
    prose = lambda n: [f"w{int(i)}" for i in rng.zipf(1.3, n) % 4000]
    rows = [(i, " ".join(prose(int(rng.integers(60, 160))))) for i in range(600)]
    passage = prose(80)
    rows += [(1000 + i, " ".join(prose(40) + passage + prose(40))) for i in range(5)]
    rows += [(1100 + i, rows[i][1]) for i in range(20)]
    for i in range(20):
        words = rows[50 + i][1].split()
        words[len(words) // 2] = "edited"
        rows.append((1200 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"{c}{int(k)}%%" for c, k in zip(rng.choice(list("#$&"), 70), rng.integers(0, 500, 70)))) for i in range(120)]
    path = str(tmp_path_factory.mktemp("corpus"))
    made = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 2000), 0) for i, _ in rows if i % 2 == 0 or i >= 2000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        if name != names[-1]:
            assert docs.columns == COLUMNS
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    quality, near, cut, mixed, encoded = (seen[n] for n in names)
    clean, junk = {i for i in quality if i < 2000}, {i for i in quality if i >= 2000}
    assert len(clean) >= 0.97 * 645 and len(junk) <= 6
    assert not [i for i in range(1100, 1120) if i in near and i - 1100 in near]
    assert not [i for i in range(1200, 1220) if i in near and i - 1150 in near]
    assert set(range(600)) & set(quality) <= set(near)
    holders = sorted(i for i in range(1000, 1005) if i in near)
    for i in holders[1:]:  # words beside the passage may agree by chance
        assert 70 <= len(cut[i]["text"].split()) <= 80 and cut[i]["n_chars"] == len(cut[i]["text"])
    assert len(cut[holders[0]]["text"].split()) == 160
    assert set(mixed) <= set(cut) and set(encoded) == set(mixed)
    assert all(r["round_trip"] for r in encoded.values())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and wordless texts, one very long text, ties, repeated rows and columns with clashing names."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{int(i)}" for i in rng.zipf(1.3, n) % 3000)
    texts = [prose(90) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(40 + i, texts[0], "en", "s0", 1) for i in range(6)]  # ties
    rows += [rows[3], rows[3], (3, None, None, None, None)]  # repeated rows, and an id with two texts
    rows += [(None, texts[5], None, None, None), (None, None, None, None, None), (None, prose(80), "en", None, 7)]
    rows += [(70, "", "en", "s1", 0), (71, " \n\t", "en", "s1", 3), (72, None, "de", "s2", None), (73, prose(60000), "en", "s2", None), (74, "x" * 100000, "en", "s2", None)]
    return spark.createDataFrame([(*r, 1.0, "a", "b") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rate double, `__node` string, copies string").repartition(4).cache()


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")


def test_stages_on_odd_documents(spark, folder, odd):
    """What each stage does with them, as its docstring says; an empty table stays empty."""
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, odd.limit(0), folder).count() == 0, name
    before = Counter(key(r) for r in odd.collect())
    kept = {n: [r for r in stages[n](spark, odd, folder).collect()] for n in stages}
    quality, near, cut, mixed, encoded = kept.values()
    assert quality and all(before[key(r)] for r in quality) and all((r["text"] or "").split() for r in quality)
    assert Counter(key(r) for r in quality)[(True, 3, odd.filter("doc_id = 3 AND text IS NOT NULL").first()["text"])] in (0, 3)
    distinct = {r["text"] for r in odd.collect() if (r["text"] or "").split()}
    words = Counter(r["text"] for r in near if (r["text"] or "").split())
    assert set(words) == distinct and set(words.values()) == {1}
    wordless = [k for k in before if not k[2].split()]
    assert Counter(k for r in cut if not (k := key(r))[2].split()) == Counter({k: before[k] for k in wordless})
    assert {r["doc_id"] for r in cut} >= {0, 1, 70, 71, 72, 73, 74} and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut)
    assert {key(r) for r in mixed} <= set(before) and all(r["doc_id"] is None or before[key(r)] for r in mixed)
    again = stages["mixing sources to target weights"](spark, odd, folder).collect()
    assert Counter(map(key, again)) == Counter(map(key, mixed))
    assert len(encoded) == sum(before.values()) and all(r["round_trip"] for r in encoded)
    assert all(list(r.asDict()) == COLUMNS for rows in (quality, near, cut, mixed) for r in rows[:1])


def test_run_is_the_stages(spark, folder):
    made = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "source", "ids", "n_tokens", "round_trip"} <= set(made.columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder).cache()
    copies = source_mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert made.count() == copies


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    show = lambda df: sorted(tuple("null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and show(got) == show(want)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries()) == list(range(1, 14))
