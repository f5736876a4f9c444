"""Near duplicates at the threshold, in odd rows and in hot groups."""

import numpy as np
import pytest

from hexflow.llm import minhash
from tests.llm.test_llm import _brute_minhash, _shingles, grouped, none, words


def variants(seed, n, length=200):
    """Texts of one family whose pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"{w}x{seed}" for w in words(length, seed)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(1, 4)):
            w[at] = f"edit{seed}n{k}"
        out.append(" ".join(w[int(rng.integers(0, 6)) :]))
    return out


@pytest.mark.parametrize("settings", [minhash.MinHash(block=3), minhash.STAGE], ids=["op1", "stage"])
def test_no_link_near_the_threshold_is_lost(spark, settings):
    families = [variants(seed, 10) for seed in range(50)]
    rows = [(k * 7919 % 500_009, t) for k, t in enumerate(t for f in families for t in f)]
    sets = {i: _shingles(t) for i, t in rows}
    links, near = [], 0
    for f in range(len(families)):
        ids = [i for i, _ in rows[f * 10 : f * 10 + 10]]
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                near += 0.7 < share < 0.95
                links += [(a, b)] if 100 * len(sets[a] & sets[b]) >= settings.percent * len(sets[a] | sets[b]) else []
    assert near > 1500 and 300 < len(links) < 2250
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    assert got == grouped(links, sets)


def test_every_link_between_bucket_members_is_found():
    """All members of a bucket but its head's component, against all members: no pair is lost."""
    import pyarrow as pa

    p = minhash.MinHash()
    texts = [t for seed in range(3) for t in variants(seed, 12)]
    flat, offsets = minhash.shingle_sets(pa.array(texts), p.shingle)
    s = (minhash.sketch(flat, offsets, p.t) & np.uint64(255)).astype(np.uint8)
    rows = [{"bucket": 1, "i": 0, "j": 1, "doc_id": k, "component": k, "blk": side, "sketch": s[k].tobytes(), "band": 0, "text": t, "bands": [1] * p.bands} for side in (0, 1) for k, t in enumerate(texts)]
    names = list(rows[0])
    batch = pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows])
    out = pa.Table.from_batches(minhash._block_links(p)(iter([batch]))).to_pylist()
    brute = {i: v[1] for i, v in _brute_minhash(list(enumerate(texts))).items()}
    assert grouped([(r["a"], r["b"]) for r in out], range(len(texts))) == brute


def test_rows_without_or_with_shared_ids(spark):
    a, b, c = (" ".join(words(40, k)) for k in (1, 2, 3))
    rows = [(None, a), (None, a), (1, a), (2, a), (5, b), (5, c), (6, b), (7, c), (8, None), (8, None)]
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(None, None, True), (None, None, True), (1, 1, True), (2, 1, False), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (8, 8, True)], key=str)
    assert minhash.near_duplicates(none(spark)).count() == 0


def test_hot_group_is_one_component(spark):
    """Hundreds of near copies that miss their bucket's head, beside hundreds of exact ones."""
    texts = variants(9, 300, 400) + [" ".join(words(50, 4))] * 300
    rows = list(enumerate(texts, 10)) + [(1, " ".join(words(60, 5)))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v[1] for i, v in _brute_minhash(rows).items()}


def test_pipeline_keeps_rows_without_ids(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(words(40, 1))
    docs = spark.createDataFrame([(None, text, "en", "a", 1), (1, text, "en", None, 1), (2, text, None, "a", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.minhash_stage(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None", "None"]
