"""Wide vectors, odd ids, gradients, license spans and whole operators against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hexflow.llm import decontam, hnsw, license_scan, substring, toxicity, warc
from tests.llm.test_llm import _brute_substring, grouped, words

RNG = np.random.default_rng(11)


def _links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T >= 0.9


def test_wide_vectors_in_many_shards(spark):
    """1,024 dimensions, shards of some 50 vectors, queries in several parts and pieces."""
    x = RNG.normal(size=(260, 1024))
    x[100:140] = x[100] + 0.02 * RNG.normal(size=(40, 1024))
    x[200:203] = x[0]
    s = hnsw.Settings(shards=1, shard_bytes=50 * (14 * 1024 + 12 * 12 + 100), query_vectors=90, piece=16)
    assert s.shard_size(1024) == 50
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), s).collect()}
    near = _links(x)
    comp = grouped([(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))], range(260))
    assert got == {k: (int(near[k].sum()) - 1, comp[k]) for k in range(260)}


def test_vectors_without_or_with_shared_ids(spark):
    a, b = RNG.normal(size=8).tolist(), RNG.normal(size=8).tolist()
    rows = [(None, a), (None, a), (1, a), (2, a), (3, b), (3, [-v for v in b]), (4, b), (5, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert [g[2:] for g in got if g[0] is None] == [(None, True)] * 2
    assert {g[0]: g[2] for g in got if g[0]} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    with pytest.raises(Exception, match="differ in length"):
        hnsw.near_duplicates(spark.createDataFrame([(1, a), (2, a[:4])], "vec_id long, embedding array<double>")).collect()


def test_later_pieces_keep_the_audited_beam():
    x = RNG.normal(size=(2000, 16))
    x[:300] = x[:10].repeat(30, axis=0) + 0.05 * RNG.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, counter = hnsw.Settings(), {}
    graph = hnsw.Graph(x, s)
    got = [r for a in (0, 700, 1400) for r in hnsw.linked(graph, x, x[a : a + 700], s, counter)]
    truth = x @ x.T >= 0.9
    assert counter["audited"] > 0 and counter["found"] >= 0.99 * counter["audited"]
    assert sum(truth[k, rows].sum() for k, rows in enumerate(got)) >= 0.97 * truth.sum() and all(truth[k, rows].all() for k, rows in enumerate(got))


def test_stretches_are_told_apart_by_the_second_hash():
    values = np.array([5, 5, 5, 9], dtype=np.uint64)
    checks = np.array([1, 2, 1, 1], dtype=np.uint64)
    distinct, check, inverse, low = substring._distinct_stretches(values, checks, np.array([40, 30, 20, 10]))
    assert distinct.tolist() == [5, 5, 9] and check.tolist() == [1, 2, 1] and inverse.tolist() == [0, 1, 0, 2] and low.tolist() == [20, 30, 10]
    packed = [(7, substring._pack(values[:2], checks[:2], np.array([40, 30]))), (8, substring._pack(values[2:], checks[2:], np.array([20, 10])))]
    assert {c: substring._unpack(p, "i8")[0].tolist() for c, p in substring._smallest(packed)} == {7: [20, 30], 8: [20, 10]}


def test_substring_rows_without_ids_come_last(spark):
    a, b = " ".join(words(30, 1)), " ".join(words(30, 2))
    rows = [(None, a), (5, a), (None, b), (None, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 0), ("None", 0), ("None", 0), ("None", 30)]
    df = spark.createDataFrame([(k, " ".join(words(40, k % 3) + words(25, 50 + k))) for k in range(12)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df).collect()}
    assert got == _brute_substring([(r.doc_id, r.text) for r in df.collect()])


# the classifier


def _direct_score(model, text):
    """The classifier word by word, filter by filter."""
    s = model.settings
    vectors = [model.embed[b].sum(axis=0) for b in toxicity.word_buckets((text or "").split(), s)]
    logit = model.bias
    for j, width in enumerate(s.widths):
        for f in range(s.filters):
            best = 0.0
            for at in range(len(vectors)):
                total = float(model.conv_bias[j][f])
                for k in range(width):
                    if at + k < len(vectors):
                        total += float(vectors[at + k] @ model.conv[j][k][:, f])
                best = max(best, total)
            logit += best * float(model.out[j * s.filters + f])
    return 1 / (1 + math.exp(-(model.scale * logit + model.shift)))


def _small_model(rng, s):
    f = s.filters
    return toxicity.Model(s, rng.normal(0, 0.5, (s.buckets, s.dim)), [rng.normal(0, 0.5, (w, s.dim, f)) for w in s.widths], [rng.normal(0, 0.2, f) for _ in s.widths], rng.normal(0, 0.5, f * len(s.widths)), -0.3, 1.3, 0.2)


def test_scores_are_those_of_a_direct_convolution():
    s = toxicity.Settings(buckets=64, dim=4, filters=3)
    model = _small_model(RNG, s)
    texts = ["one", "one two", "a b c d e f g", None, "", " ".join(words(300, 3)), "x y"]
    got = toxicity.scores(model, pa.array(texts, pa.string()))
    assert np.allclose(got, [_direct_score(model, t) for t in texts], atol=1e-9)


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(2)
    s = toxicity.Settings(buckets=40, dim=3, filters=2)
    m = _small_model(rng, s)
    params = {"embed": m.embed, "out": m.out, "bias": np.array([m.bias])} | {f"conv{j}": c for j, c in enumerate(m.conv)} | {f"cb{j}": c for j, c in enumerate(m.conv_bias)}
    by_word = rng.integers(0, 40, (12, 3))
    texts = [rng.integers(0, 12, n) for n in (5, 1, 0, 9)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        total = 0.0
        for t, y in zip(texts, labels):
            vectors = params["embed"][by_word[t]].sum(axis=1)
            logit = float(params["bias"][0])
            for j, width in enumerate(s.widths):
                for f in range(s.filters):
                    best = [params[f"cb{j}"][f] + sum(float(vectors[a + k] @ params[f"conv{j}"][k][:, f]) for k in range(width) if a + k < len(t)) for a in range(len(t))]
                    logit += max([0.0, *best]) * params["out"][j * s.filters + f]
            total += math.log(1 + math.exp(-logit if y else logit))
        return total / len(texts)

    grads, rows, adds = toxicity.gradients(params, s, by_word, texts, labels)
    grads["embed"] = np.zeros_like(m.embed)
    np.add.at(grads["embed"], rows, adds)
    for name, g in grads.items():
        flat = params[name].reshape(-1)
        for at in rng.choice(len(flat), min(25, len(flat)), replace=False):
            kept = flat[at]
            flat[at] = kept + 1e-6
            up = loss()
            flat[at] = kept - 1e-6
            down = loss()
            flat[at] = kept
            assert g.reshape(-1)[at] == pytest.approx((up - down) / 2e-6, abs=1e-6), name


def test_thresholds_by_language(spark):
    """French rows carry a weaker sign, so their threshold is their own; scores don't read the language."""
    rows = []
    for k in range(1600):
        fr, bad = k % 2 == 1, k % 4 < 2
        sign = (["zork"] if k % 16 < 14 else []) if bad and not fr else (["grum"] if bad and k % 16 < 9 else [])
        rows.append((k, " ".join(words(15, k) + sign), "fr" if fr else "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(1600)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, toxicity.Settings(epochs=3))
    assert set(model.thresholds) == {"en", "fr"}
    out = toxicity.score(df, model)
    assert {(r.lang, r.threshold) for r in out.select("lang", "threshold").distinct().collect()} == set(model.thresholds.items())
    assert out.filter("rejected != (score >= threshold)").count() == 0
    other = toxicity.score(df.withColumn("lang", df.text), model)
    assert other.select("doc_id", "score").exceptAll(out.select("doc_id", "score")).count() == 0 and other.filter(f"threshold != {model.settings.threshold}").count() == 0


# licenses


def test_common_subsequence_is_longest():
    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for seed in range(60):
        rng = np.random.default_rng(seed)
        a, b = (["abcd"[k] for k in rng.integers(0, 4, n)] for n in rng.integers(0, 14, 2))
        at = license_scan.common_subsequence(a, b)
        rest = iter(b)
        assert len(at) == brute(a, b) and at == sorted(set(at)) and all(any(a[k] == w for w in rest) for k in at)


def test_overlapping_spans_keep_every_disjoint_one():
    kinds = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    rows = [(1, 1, "a", 0.8, 0, 10), (1, 1, "b", 0.9, 8, 20), (1, 1, "c", 0.85, 18, 30), (1, 1, "d", 1.0, 30, 40), (2, 2, "b", 0.8, 5, 9), (2, 2, "a", 0.95, 0, 6), (2, 2, "c", 0.9, 6, 9)]
    rows.sort(key=lambda r: (r[0], r[4]))
    got = [(r["doc_id"], r["label"]) for b in license_scan._apart(iter([pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[k : k + 2]], kinds) for k in range(0, 7, 2)])) for r in b.to_pylist()]
    assert sorted(got) == [(1, "b"), (1, "d"), (2, "a"), (2, "c")]


def _edited(template, rng, share):
    w = template.split()
    for at in rng.choice(len(w), int(share * len(w)), replace=False):
        w[at] = f"other{rng.integers(1000)}"
    return " ".join(w)


def test_license_scan_against_all_windows(spark):
    """Every edited template that keeps a k-word run and the wanted share is found, and nothing else is labelled."""
    rng = np.random.default_rng(4)
    templates = [(label, " ".join(w)) for label, w in license_scan._template_words()]
    rows, planted = [], {}
    for k in range(150):
        label, text = templates[k % len(templates)]
        body = _edited(text, rng, rng.choice([0.0, 0.05, 0.1, 0.15])) if k % 5 else None
        rows.append((k, " ".join(words(30, k)) + (f" {body} " if body else " ") + " ".join(words(30, 900 + k))))
        planted[k] = (label, body)
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted_words = license_scan._template_words()
    missed = 0
    for k, text in rows:
        body = planted[k][1]
        found = set(filter(None, got[k].labels.split(",")))
        brute = {}
        for label, wanted in wanted_words:
            if body is not None and label not in brute:
                w = license_scan.folded(pa.array([text]))[0].as_py().split()
                same = license_scan.common_subsequence(w, wanted)
                grams = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} & {tuple(wanted[i : i + 4]) for i in range(len(wanted) - 3)}
                if len(same) >= 0.8 * len(wanted) and grams:
                    brute[label] = len(same) / len(wanted)
        base = set(filter(None, got[k].base_labels.split(",")))
        assert found <= set(brute) | base
        missed += bool(brute) and not found
    assert missed == 0


def test_license_rows_without_or_with_shared_ids(spark):
    mit = license_scan.TEMPLATES[0][1]
    rows = [(None, mit), (None, "nothing here"), (3, mit), (3, "other text"), (3, mit)]
    got = sorted((str(r.doc_id), r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", ""), ("3", "mit"), ("3", "mit"), ("None", ""), ("None", "mit")]


# decontamination as a whole


def _brute_leaks(docs, items, s):
    """All pieces scored against all windows of two blocks, then the overlap check, without an index."""
    texts = {i: decontam.item_words(t) for i, t in items}
    pieces = [(i, a, w[a : a + s.piece_words]) for i, w in texts.items() for a in range(0, len(w), s.piece_words)]
    df = Counter(w for *_, p in pieces for w in set(p))
    mean = sum(len(p) for *_, p in pieces) / len(pieces)
    stride = max([32, *(min(len(w), s.piece_words) for w in texts.values())])
    idf = {w: math.log(1 + (len(pieces) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = set()
    for doc, text in docs:
        w = decontam.item_words(text)
        near = defaultdict(set)
        for k in range(-(-len(w) // stride)):
            seen = set(w[k * stride : (k + 2) * stride])
            around = w[max(0, (k - 1) * stride) : (k + 3) * stride]
            for i, _, piece in pieces:
                tf = Counter(piece)
                weight = {t: idf[t] * n * (s.k1 + 1) / (n + s.k1 * (1 - s.b + s.b * len(piece) / mean)) for t, n in tf.items()}
                if sum(v for t, v in weight.items() if t in seen) >= s.threshold * sum(weight.values()) - 1e-12:
                    n = min(s.shingle, len(texts[i]))
                    grams = {tuple(around[a : a + n]) for a in range(len(around) - n + 1)}
                    near[i] |= {a + x for a in range(len(texts[i]) - n + 1) if tuple(texts[i][a : a + n]) in grams for x in range(n)}
        for i, covered in near.items():
            cut, size = decontam.answer_start(dict(items)[i]), len(texts[i])
            question = sum(x < cut for x in covered) / cut if cut else 1.0
            answer = sum(x >= cut for x in covered) / (size - cut) if size > cut else 1.0
            if len(covered) / size >= s.overlap and min(question, answer) >= s.part_overlap:
                out.add((doc, i))
    return out


def test_leaks_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    items = [(k, " ".join(words(int(n), 700 + k))) for k, n in enumerate(rng.integers(8, 200, 25))]
    docs = []
    for k in range(60):
        body = items[int(rng.integers(25))][1].split()
        if k % 3 == 0:
            body = [w if rng.random() > 0.04 else "changed" for w in body]
        elif k % 3 == 1:
            body = body[: len(body) // 2]
        docs.append((k, " ".join(words(int(rng.integers(0, 300)), k) + body + words(int(rng.integers(0, 300)), 300 + k))))
    s = decontam.Settings()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, s).collect()}
    assert got == _brute_leaks(docs, items, s) and len(got) > 15


# WARC as a whole


def test_warc_query_against_records_made_by_hand(spark, small):
    """Ids link, digests and lengths are those of the bytes, and the text is that of the page without markup."""
    import base64
    import hashlib

    from hexflow.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op9_warc_derivatives(spark, small).collect()
    assert len(got) == len(pages) and len({r.metadata_id for r in got} | {r.conversion_id for r in got} | {r.response_id for r in got}) == 3 * len(pages)
    for r in got:
        page = pages[r.page_id].html or ""
        assert r.metadata_refers_to == r.conversion_refers_to == r.response_id and r.target_uri == pages[r.page_id].url
        assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
        assert r.n_links == len(re.findall(r"<a href=", page)) and r.conversion_digest == warc.sha1(warc.page_parts(page)[0].encode())
