"""Every stage of the pipeline on its own input, against a version without its method, and odd tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexflow.llm import decontam, mixing, queries, toxicity
from tests.llm.test_llm import words
from tests.llm.test_operators_more import _brute_leaks, _direct_score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    items = [(k, " ".join(words(30, 700 + k))) for k in range(5)]
    rows = [(k, " ".join(words(20 + k % 50, k) + (["zork"] if k % 4 == 0 else []) + (items[k % 5][1].split() if k % 11 == 0 else [])), "en" if k % 2 else "fr", f"s{k % 3}", 1) for k in range(400)]
    rows += [(None, "no id", None, None, None), (900, None, None, None, None), (901, "", "en", "s0", 0), (902, "tie a b c d e", "en", "s1", 1), (902, "tie a b c d e", "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), spark.read.parquet(f"{folder}/documents.parquet"), items


def _rows(df):
    return Counter(map(tuple, df.collect()))


def test_toxicity_stage(spark, tables):
    folder, docs, _ = tables
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = corpus_pipeline.toxicity_stage(spark, docs, folder)
    wanted = Counter()
    for r in docs.collect():
        score = _direct_score(model, r.text)
        limit = model.thresholds.get(r.lang, model.settings.threshold)
        assert abs(score - limit) > 1e-6
        wanted[tuple(r)] += score < limit
    assert _rows(kept) == +wanted and kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def test_decontamination_stage(spark, tables):
    folder, docs, items = tables
    kept = corpus_pipeline.decontamination_stage(spark, docs, folder)
    leaked = {d for d, _ in _brute_leaks([(r.doc_id, r.text) for r in docs.collect()], items, decontam.Settings())}
    assert len(leaked) > 20 and _rows(kept) == Counter(tuple(r) for r in docs.collect() if r.doc_id is None or r.doc_id not in leaked)


def test_mixing_stage(spark, tables):
    folder, docs, _ = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    copies = {}
    for doc, _, _, _, _, n in con.execute(mixing.ORACLE).fetchall():
        copies[doc] = max(n, copies.get(doc, 0))
    got = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, folder).collect())
    have = Counter(r.doc_id for r in docs.collect())
    alike = {d for d in have if have[d] == 1}
    assert {d: got[d] for d in alike if got[d]} == {d: copies[d] for d in alike if copies[d]}


def test_token_stage(spark, tables):
    from tokenizers import Tokenizer

    folder, docs, _ = tables
    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))  # those without an id come first
    wanted, start = Counter(), 0
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        wanted[(r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert _rows(corpus_pipeline.token_stage(spark, docs, folder)) == wanted


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_carry_further_columns(spark, tables):
    folder, docs, _ = tables
    more = docs.withColumn("score", F.lit("mine")).withColumn("threshold", F.lit(7)).withColumn("component_id", F.lit("x")).withColumn("kept", F.lit("y")).limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns, name
        assert out.select("score", "threshold", "component_id", "kept").distinct().collect() == [("mine", 7, "x", "y")], name


def test_fit_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, " ".join(words(50, k)) + (" zork" if k % 2 else "")) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    assert not toxicity.fit(docs, labels, toxicity.Settings(max_bytes=1)).embed.any()
    assert toxicity.fit(docs, labels, toxicity.Settings(epochs=1)).embed.any()
    assert toxicity.scores(toxicity.fit(docs, labels, toxicity.Settings(max_bytes=1)), pa.array(["a"])).tolist() == [0.5]
