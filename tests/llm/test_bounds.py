"""What a task holds doesn't grow with the input."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from hexflow.llm import substring
from hexflow.store import Scratch, shared_dir
from tests.llm.test_llm import words


def test_replies_stream_past_their_chunk(spark):
    """No aggregate gathers a chunk's replies, and the rows of the chunk table lie in row groups of a few MB."""
    texts = spark.createDataFrame([(k, " ".join(words(130_000, k))) for k in range(8)], "doc_id long, text string").coalesce(1)
    before = {p for p in Path(shared_dir(spark).removeprefix("file:")).glob("substring-*")}
    out = substring.remove_repeats(texts, chunk_bytes=1 << 19)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    (mine,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("substring-*")) - before
    groups = [f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, mine.glob("chunks/*.parquet")) for k in range(f.metadata.num_row_groups)]
    assert sum(groups) >= 8 and out.count() == 8


def test_row_groups_close_after_a_few_large_rows(spark):
    """A hundred rows were buffered before the first look at their size."""
    import os

    rows = spark.range(40, numPartitions=1).rdd.map(lambda r: (r.id, os.urandom(1 << 20))).toDF("id long, payload binary")
    Scratch(spark, "groups").save(rows, "rows", options=substring._FEW_ROWS)
    files = sorted(Path(shared_dir(spark).removeprefix("file:")).glob("groups-*/rows/*.parquet"))
    assert max(f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, files) for k in range(f.metadata.num_row_groups)) <= 16


def test_toxicity_learns_from_every_labelled_row(spark):
    """17,000 labelled rows; the toxic ones use a word of their own, one in each 1,000 rows."""
    from pyspark.sql import functions as F

    from hexflow.llm import toxicity

    rows = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some plain words"), F.concat(F.lit("w"), F.floor(F.col("id") / 8)), F.when(F.col("id") % 2 == 0, F.lit("vile"))).alias("text"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    taught = rows.filter(~toxicity.held_out(F.col("doc_id"))).count()
    assert taught > 16_000
    s = toxicity.Settings(epochs=1, least_texts=1, shard_rows=3_000)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), s)
    seen = toxicity.held_out(F.col("doc_id")) | (F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0)
    known = {r.w for r in rows.filter(~seen).select(F.element_at(F.split("text", " "), 4).alias("w")).distinct().collect()}
    whole = toxicity.word_buckets(sorted(known), s)[:, 0]
    assert model.embed[whole].any(axis=1).mean() > 0.999
    out = toxicity.score(rows.select("doc_id", "text", "toxic"), model).groupBy("toxic").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    lo, hi = {r.toxic: r.lo for r in out}[1], {r.toxic: r.hi for r in out}[0]
    assert lo > 0.9 and hi < 0.1


def test_epochs_read_shards_where_they_lie(spark, monkeypatch):
    """Texts were dealt anew for every epoch, and models for every sum; no table stays once the model is there."""
    from pyspark.sql import functions as F

    from hexflow.llm import toxicity

    plans = {}
    save = Scratch.save

    def noted(self, df, name, *a, **b):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name, *a, **b)

    monkeypatch.setattr(Scratch, "save", noted)
    monkeypatch.setattr(toxicity, "_SLICE", 1 << 10)
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("plain words"), F.when(F.col("id") % 2 == 0, F.lit("vile"))).alias("text"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("toxicity-*"))
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), toxicity.Settings(epochs=2, shard_rows=100, merged=2))
    assert toxicity.scores(model, pa.array(["plain words vile", "plain words"])).round().tolist() == [1, 0]
    sums = [name for name in plans if name.startswith("epoch-")]
    assert len(sums) > 4 and not any("Exchange" in plans[name] for name in sums)
    (mine,) = set(folder.glob("toxicity-*")) - before
    assert not list(mine.rglob("*.parquet"))


def test_sums_of_models_are_the_same_in_any_order(monkeypatch):
    import numpy as np

    from hexflow.llm import toxicity

    rng = np.random.default_rng(0)
    monkeypatch.setattr(toxicity, "_ROW", 64)
    like = {"embed": np.zeros((64, 4)), "out": np.zeros(9)}
    states = [toxicity._weighted({k: rng.normal(0, 1, v.shape) for k, v in like.items()}, rng.integers(0, 5, 64), n) for n in (3, 700, 16_000, 1)]
    rows = [batch for x in states for batch in toxicity._cut(x)]
    assert max(batch.num_rows for batch in rows) == 8
    one, other = (toxicity._averaged({k: v.view(np.int64) for k, v in toxicity._joined(toxicity._summed(iter(x))).items()}, like) for x in (rows, rows[::-1]))
    assert all((one[k] == other[k]).all() for k in one)
    n = np.array([3, 700, 16_000, 1])
    assert np.allclose(one["out"], sum(x["out"] * toxicity._UNIT for x in states) / n.sum(), atol=1e-6)


def test_shards_and_scores_do_not_depend_on_slices(monkeypatch):
    import numpy as np

    from hexflow.llm import toxicity

    texts = pa.array([" ".join(words(k % 40, k)) for k in range(60)] + [None, ""], pa.string())
    s = toxicity.Settings(buckets=500, dim=4, filters=3)
    rng = np.random.default_rng(1)
    model = toxicity.Model(s, rng.normal(0, 0.5, (500, 4)), [rng.normal(0, 0.5, (w, 4, 3)) for w in s.widths], [rng.normal(0, 0.2, 3) for _ in s.widths], rng.normal(0, 0.5, 9), 0.1)
    rows = pa.record_batch([texts, pa.array([0, 1] * 31, pa.int32())], ["text", "toxic"])
    whole, raw = toxicity._packed([rows], s), toxicity.raw_scores(model, texts)
    monkeypatch.setattr(toxicity, "_SLICE", 300)
    monkeypatch.setattr(toxicity, "_HELD", 25)
    parts = toxicity._packed([rows.slice(0, 7), rows.slice(7)], s)
    assert len(parts["by_word"]) > len(whole["by_word"]) and (parts["texts_of"] == whole["texts_of"]).all() and (parts["starts"] == whole["starts"]).all() and parts["labels"].tolist() == [0, 1] * 31
    assert (parts["by_word"][parts["codes"]] == whole["by_word"][whole["codes"]]).all()
    assert np.allclose(toxicity.raw_scores(model, texts), raw, atol=1e-12)


def test_scratch_files_lie_alone(spark):
    """A checksum file beside each costs a process more on a local disk."""
    scratch = Scratch(spark, "alone")
    assert scratch.save(spark.range(10, numPartitions=2), "rows").count() == 10
    folder = Path(scratch.path("rows").removeprefix("file:"))
    assert list(folder.glob("*.parquet")) and not list(folder.glob(".*.crc"))


def test_small_tables_are_few_files(spark, monkeypatch):
    """Every table had as many files as there are shuffle partitions, and each file and task folder starts a process."""
    from hexflow.llm import components, minhash, mixing, token_store
    from hexflow.llm.queries import tokenizer_path
    from tests.llm.test_llm import _brute_minhash
    from tests.llm.test_near import variants

    files = {}
    write = Scratch._write

    def noted(self, df, path, *a):
        write(self, df, path, *a)
        files[path.rpartition("/")[2]] = len(list(Path(path.removeprefix("file:")).glob("part-*")))

    monkeypatch.setattr(Scratch, "_write", noted)
    asked = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in asked}
    rows = [(k, t, "ab"[k % 2]) for k, t in enumerate([t for seed in range(4) for t in variants(seed, 10)] + [" ".join(words(30, 1))] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        expected = {i: v[1] for i, v in _brute_minhash([r[:2] for r in rows]).items()}
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == expected
        assert len(files) > 10 and all(n == 1 for name, n in files.items() if name != "signatures")
        monkeypatch.setattr(components, "_EDGES", 10)
        monkeypatch.setattr(minhash, "_DOCS", 20)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == expected
        assert max(files["star-0"], files["all-0"]) > 1 and files["result"] == 3
        assert mixing.mix(docs).count() == token_store.token_store(docs, tokenizer_path()).count() == len(rows)
        assert files["starts"] == files["manifest"] == 1
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
