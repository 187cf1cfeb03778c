"""Registered text queries and the pipeline, on the smallest tables and on planted cases."""

import collections
import random
import re

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from compare import check, connect
from oscilla.llm.queries import ORACLES, PLANS


def test_registered():
    plans = entry_point.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in plans if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert plans["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert not any(re.search(r"\bLIMIT\b|USING SAMPLE", sql) for sql in ORACLES.values())


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, sf_dir, name):
    ok, message, rows = check(spark, name, PLANS[name], ORACLES.get(name), sf_dir, connect(sf_dir))
    assert ok and rows > 0, message


def planted(spark, folder):
    """Clean, poor, copied and nearly copied documents, and labels for two thirds of them."""
    rng = random.Random(13)

    def text(n):
        return " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))

    rows, labels = [], []
    for i in range(240):
        poor = i % 6 == 0
        rows.append((i, "same " * 80 if poor and i % 4 else "|".join(text(50).split()) if poor else text(rng.randint(60, 300)), "en", "big" if i % 2 else f"s{i % 5}", 0))
        if i % 9 < 6:
            labels.append((i, int(not poor), 0))
    clean = [r for r in rows if r[0] % 6]
    rows += [(1000 + r[0], r[1].replace(" ", "\n "), *r[2:]) for r in clean[:20]]
    rows += [(2000 + r[0], r[1].upper(), *r[2:]) for r in clean[20:40]]
    rows += [(3000, None, "en", "big", 0), (3001, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert n == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.toPandas()
    first = set(kept["quality_classifier"]["doc_id"])
    assert not {i for i in range(240) if i % 6 == 0} & first
    assert len({i for i in range(240) if i % 6} - first) <= 4
    second = set(kept["exact_dedup"]["doc_id"])
    # of a copy and its original the longer text stays
    assert not {i % 1000 for i in second if 1000 <= i < 2000} & second
    third = set(kept["simhash_near_dedup"]["doc_id"])
    assert not {i for i in third if 2000 <= i < 3000 and i - 2000 in second}
    assert second - third <= set(range(2000, 4000))
    fourth = kept["source_mixing"]
    assert set(fourth["doc_id"]) <= third and fourth["doc_id"].is_unique
    before = collections.Counter(kept["simhash_near_dedup"]["source"])
    after = collections.Counter(fourth["source"])
    assert after["big"] < before["big"]
    packed = kept["best_fit_packing"]
    assert set(packed["doc_id"]) == set(fourth["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert len(rows) > len(first) > len(second) > len(third) >= len(fourth)


def test_run_equals_its_stages(spark, tmp_path):
    planted(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024 and out["doc_id"].nunique() > 100
