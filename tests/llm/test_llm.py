"""The training-data operators against brute force, exact round trips and odd inputs."""

import gzip
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexflow.llm import components, decontam, hnsw, html_extract, license_scan, minhash, mixing, queries, substring, token_store, toxicity, warc
from hexflow.llm.scratch import Scratch
from hexflow.llm.text import split_words

RNG = np.random.default_rng(5)
VOCAB = [f"w{k:03d}" for k in range(400)]


def words(n, seed):
    return [VOCAB[k] for k in np.random.default_rng(seed).integers(0, len(VOCAB), n)]


def corpus():
    """Texts with exact and near copies, a shared passage, nulls, empty, short, long and odd ones."""
    base, shared = words(120, 1), words(30, 2)
    texts = [" ".join(base), " ".join(base).upper(), None, "", " \t\n ", "one", "One", "a b c d", "a b c d", "x\x0by\x1cz   é ÉÀ"]
    for k in range(12):
        w = list(base)
        w[k * 7 % 100] = f"changed{k}"
        texts.append("  ".join(w))
    texts += [" ".join(words(40, 10 + k) + shared + words(20, 30 + k)) for k in range(8)]
    texts.append(" ".join(words(6000, 99)))
    texts += [" ".join(words(60, 200 + k)) for k in range(10)]
    return texts


def docs_of(spark, texts, **extra):
    rows = [(7 * k % 1009, t, "text_a", 1.5, "b") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, score double, component_id string")


def none(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def grouped(links, nodes):
    parent = {v: v for v in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {v: find(parent, v) for v in nodes}


def test_words_are_cut_at_ascii_white_space():
    w = split_words(pa.array([" a\x0bb\x1cc d ", None, "", "\t"]))
    assert [w.vocab[int(c)].as_py() for c in w.codes] == ["a", "b\x1cc d"] and w.counts.tolist() == [2, 0, 0, 0]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (21, 20), (5, 5)] + [(100 + k, 101 + k) for k in range(40)]
    got = dict(components.components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c").collect())
    want = grouped(links, {v for e in links for v in e})
    assert got == {v: c for v, c in want.items() if v != c}
    assert components.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _brute_minhash(rows, percent=85):
    sets = {i: _shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = grouped(links, ids)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_minhash_matches_brute_force(spark):
    df = docs_of(spark, corpus())
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(df).collect()}
    assert got == _brute_minhash([(r.doc_id, r.text) for r in df.collect()])
    assert minhash.near_duplicates(none(spark)).count() == 0


def test_minhash_links_members_that_miss_the_head(spark):
    """A chain: neighbours link, ends don't."""
    base = words(200, 3)
    texts = [" ".join(base[: 200 - 9 * k]) for k in range(8)]
    df = docs_of(spark, texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, minhash.MinHash(block=2)).collect()}
    assert got == {i: v[1] for i, v in _brute_minhash([(r.doc_id, r.text) for r in df.collect()]).items()}


def test_minhash_first_shared_bucket_is_told_by_the_keys():
    """The sketches agree in band 0 by chance, the buckets only in band 1."""
    p = minhash.MinHash(rows=1, bands=2)
    text = " ".join(words(30, 4))
    names = ["bucket", "i", "j", "doc_id", "component", "blk", "sketch", "band", "text", "bands"]
    rows = [(77, 0, 0, doc, doc, 0, b"\x01\x02", 1, text, [key, 77]) for doc, key in ((1, 5), (2, 6))]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    out = pa.Table.from_batches(minhash._block_links(p)(iter([batch]))).to_pylist()
    assert out == [{"a": 1, "b": 2}]


def test_sketch_fills_and_estimates():
    flat = RNG.integers(1, 2**63, 900).astype(np.uint64)
    a, b = np.unique(flat[:800]), np.unique(flat[100:])
    s = minhash.sketch(np.concatenate((a, b, flat[:1])), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]), 344)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.1


def test_embeddings_match_brute_force(spark):
    x = RNG.normal(size=(300, 16))
    x[50:90] = x[50] + 0.05 * RNG.normal(size=(40, 16))
    x[90:95] = x[0]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, [float("inf")] * 16, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), hnsw.Settings(shards=2)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T >= 0.9
    comp = grouped([(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sims, 1)))], range(305))
    assert got == {k: (int(sims[k].sum()) - 1 if k < 300 else 0, comp[k], comp[k] == k) for k in range(305)}
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall():
    x = RNG.normal(size=(3000, 24))
    x[:600] = x[:20].repeat(30, axis=0) + 0.08 * RNG.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = hnsw.linked(hnsw.Graph(x, hnsw.Settings()), x, x, hnsw.Settings())
    truth = x @ x.T >= 0.9
    assert sum(truth[k, rows].sum() for k, rows in enumerate(got)) >= 0.97 * truth.sum()
    assert all(truth[k, rows].all() for k, rows in enumerate(got))


def _brute_substring(rows, n=13):
    words_ = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words_):
        for k in range(len(words_[i]) - n + 1):
            first.setdefault(tuple(words_[i][k : k + n]), i)
    out = {}
    for i, w in words_.items():
        off = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                off[k : k + n] = [True] * n
        out[i] = (len(w), sum(off), " ".join(x for x, o in zip(w, off) if not o))
    return out


@pytest.mark.parametrize("chunk", [1, 2 << 20])
def test_substring_matches_brute_force(spark, chunk):
    df = docs_of(spark, corpus() + [" ".join(words(12, 2)), " ".join(words(13, 2)), " ".join(words(20, 7) * 3)])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df, chunk_bytes=chunk).collect()}
    assert got == _brute_substring([(r.doc_id, r.text) for r in df.collect()])
    assert substring.remove_repeats(none(spark)).count() == 0


def test_substring_keeps_repeated_rows(spark):
    text = " ".join(words(20, 7))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    for chunk in (1, 1 << 20):
        assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(df, chunk_bytes=chunk).collect()) == [(1, 0), (1, 0), (2, 20)]


def test_leaks(spark):
    items = [(1, "What is the colour of the sky above the northern harbour town? It is a deep and steady blue."), (2, " ".join(words(90, 55))), (3, None), (4, ""), (5, "too short"), (6, " ".join(words(300, 56)))]
    texts = [None, "", " ".join(words(50, 60)) + " " + items[0][1].upper() + " " + " ".join(words(200, 61)), " ".join(words(300, 62)), items[1][1], " ".join(items[1][1].split()[:30]), " ".join(words(100, 63)) + " " + items[5][1]]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    df = docs_of(spark, texts)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == {(14, 1), (28, 2), (42, 6)}
    sharded = decontam.leaks(df, bench, decontam.Settings(shard_bytes=700))
    assert {(r.doc_id, r.item_id) for r in sharded.collect()} == {(14, 1), (28, 2), (42, 6)}
    assert {r.doc_id for r in decontam.without_leaks(df, bench).collect()} == {0, 7, 21, 35}
    assert decontam.leaks(none(spark), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_wand_returns_all_above_threshold():
    items = [(k, " ".join(words(40, 500 + k))) for k in range(60)]
    df = defaultdict(int)
    for _, t in items:
        for w in set(t.split()):
            df[w] += 1
    index = decontam.Index(items, df, 60, 40.0, decontam.Settings(threshold=0.3, postings_block=3))
    for k in range(60):
        terms = sorted({index.terms[w] for w in items[k][1].split()[:25] + words(30, 900 + k) if w in index.terms})
        total = defaultdict(float)
        for t in terms:
            for p, x in zip(*index.postings[t]):
                total[p] += x
        assert {p for p, _ in index.above(terms)} == {p for p, v in total.items() if v >= 0.3 - 1e-12}


def _mixing_docs(spark):
    rows = [(k, " ".join(["w"] * (k * 37 % 90)), None if k % 11 == 0 else f"s{k % 5}" if k % 3 else "s0") for k in range(400)] + [(1000, None, "s1"), (1001, "", "tiny"), (1002, "a b c", "é"), (1003, "a b c", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_matches_sql_and_its_targets(spark, tmp_path):
    df = _mixing_docs(spark)
    got = sorted(map(tuple, mixing.mix(df).collect()))
    df.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert got == sorted(con.execute(mixing.ORACLE).fetchall())
    assert all(taken <= 3 * size for _, size, _, _, taken, _ in got)
    by = defaultdict(lambda: [0, 0.0])
    sources = {r.doc_id: r.source for r in df.collect()}
    for doc, _, _, target, taken, _ in got:
        by[sources[doc]] = [by[sources[doc]][0] + taken, target]
    assert all(abs(taken - target) <= max(45, 0.02 * target) for taken, target in by.values())
    assert sum(t for _, t in by.values()) == pytest.approx(sum(size for _, size, *_ in got))
    assert mixing.mixed(df).count() == sum(c for *_, c in got)
    assert mixing.mix(none(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{main}<aside>Related</aside><div id="comments"><p>First!</p></div><form><p>Sign up</p></form><footer>&copy; Site</footer></body></html>"""


def test_html_extraction(spark):
    article = "<article><h1>Head {k} &amp; more</h1><p>Para <b>bo</b>ld {k}<br>line&nbsp;two<p>open  para\n{k}</p><ul><li>item</ul><div class='advert'>Buy</div><div class='comments'><p>me too</p></div></article>"
    plain = "<div class='wrap'><div class='body'><h2>Title {k}</h2><p>Long text number {k} with many words in it that differ {k}</p><p>And more of it {k}{k}</p></div><div class='box'>Same on all</div></div>"
    rows = [(k, f"http://a.org/{k}", PAGE.format(main=article.format(k=k))) for k in range(4)] + [(10 + k, f"https://B.org:80/{k}", PAGE.format(main=plain.format(k=f"n{k}x"))) for k in range(5)]
    rows += [(20, None, None), (21, "http://a.org/x", ""), (22, "nonsense", "<p>a < b</p> &lt;c&gt;"), (23, "http://a.org/y", "<article><p>cut o"), (20, None, None)]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert [got[k].text for k in range(4)] == [f"Head {k} & more Para bold {k} line two open para {k} item" for k in range(4)]
    assert got[12].text == "Title n2x Long text number n2x with many words in it that differ n2x And more of it n2xn2x"
    assert (got[20].text, got[21].text, got[22].text, got[23].text) == ("", "", "a < b <c>", "cut o")
    assert got[1].n_chars == len(got[1].text)
    assert html_extract.main_text(none(spark, "page_id long, url string, html string")).count() == 0


def test_html_text_that_differs_on_some_pages_stays(spark):
    """A headline that few of a host's pages have of their own, and a line that one page alone has."""
    page = "<div class='wrap'><div class='body'><h2>{h}</h2><p>Long text number {k} with many words in it that differ {k}</p><p>And more of it {k}{k}</p>{more}</div></div>"
    heads = ["News"] * 37 + ["Flood", "News", "Fire"]
    rows = [(k, f"http://c.org/{k}", page.format(h=h, k=f"n{k}x", more="<h3>Only here</h3>" if k == 5 else "")) for k, h in enumerate(heads)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith(h) for k, h in enumerate(heads)) and got[5].endswith("Only here")


def test_wrapper_has_groups_options_and_slots():
    w = html_extract.infer(["<div><h2>A</h2><p>x</p><h2>B</h2><p>y</p></div><i>z</i>", "<div><h2>C</h2><p>x</p><h2>D</h2><p>q</p><h2>E</h2><p>r</p></div><hr><table><tr><td>1</td></tr></table>"])
    text = html_extract.expression(w)
    assert "(" in text and "+" in text and "?" in text and "#TEXT" in text


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = corpus() + ["Héllo, İstanbul ½ don't<|endoftext|>stop ́x ﬁn ΑΣ S. s; 12a", " ".join(words(5000, 3)), " ".join(words(5000, 3)) + " tail"]
    df = docs_of(spark, texts).unionByName(docs_of(spark, texts[:1]))
    store = token_store.write_store(df, path, chunking=token_store.Chunking(bits=5, least=8, most=256))
    rows = sorted((r.doc_id, r.text) for r in df.collect()) if None not in texts else sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0], r[1] or ""))
    start, want = 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.read_back(spark, store).collect())) == sorted(want)
    back = sorted((r.doc_id, r.ids) for r in token_store.documents_ids(spark, store).collect())
    assert back == sorted((doc, [*t.encode(text or "", add_special_tokens=False).ids, 1]) for doc, text in rows)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg(F.sum("n")).first()[0] < start
    assert spark.read.parquet(f"{store}/manifest").filter("level = 'store'").first().n_tokens == start
    assert token_store.token_store(none(spark), path).count() == 0


def test_token_store_notices_changed_recipes(spark):
    import shutil

    store = token_store.write_store(docs_of(spark, corpus()), queries.tokenizer_path(), chunking=token_store.Chunking(bits=5, least=8, most=256))
    assert token_store.read_back(spark, store).count() == len(corpus())
    recipes = spark.read.parquet(f"{store}/recipes").toPandas()
    kinds = spark.read.parquet(f"{store}/recipes").schema
    turned = recipes.assign(digests=[d[::-1] for d in recipes.digests], counts=[c[::-1] for c in recipes.counts])
    for changed in (turned, recipes.iloc[1:]):
        shutil.rmtree(f"{store}/recipes")
        rows = [tuple(list(v) if k in ("digests", "counts") else v for k, v in r.items()) for r in changed.to_dict("records")]
        spark.createDataFrame(rows, kinds).write.parquet(f"{store}/recipes")
        with pytest.raises(ValueError, match="manifest"):
            token_store.read_back(spark, store).collect()


def test_crc_of_parts():
    a, b = b"some bytes", b"and others" * 1000
    shifted = int(token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0])
    assert shifted ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_toxicity_learns_and_holds_out(spark):
    bad = ["grumpf", "zorkle"]
    rows = [(k, " ".join(words(30, k) + ([bad[k % 2]] if k % 5 == 0 else []) + words(10, 5000 + k)), "en" if k % 2 else "fr") for k in range(800)]
    df = spark.createDataFrame([*rows, (9000, None, None), (9001, "", "en"), (9000, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(800)] + [(9001, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(df, labels, toxicity.Settings(epochs=6)).toPandas()
    held = out[out.held_out & (out.doc_id < 800)]
    assert all(bool(h) == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(out.doc_id, out.held_out))
    assert ((held.predicted == 1) == (held.doc_id % 5 == 0)).mean() > 0.97
    assert len(out) == 803 and out.score.between(0, 1).all()
    assert toxicity.classify(none(spark), labels.limit(0)).count() == 0
    assert toxicity.classify(df, labels.limit(0)).count() == 803


def test_warc_records(spark):
    html = "<html><head><title>T &amp; x</title></head><body><p>One<br>two</p><script>no</script><a href='/q?a=1&amp;b=2'>l</a></body></html>"
    df = spark.createDataFrame([(1, "http://x.org/a", html, "r"), (2, None, None, "r"), (3, "http://x.org/ü\n", "", "r"), (1, "http://x.org/a", html, "r")], "page_id long, url string, html string, response_id string")
    rows = warc.derivatives(warc.responses(df)).collect()
    one = next(r for r in rows if r.page_id == 1)
    m, fields = warc.parse(gzip.decompress(one.metadata))
    c, text = warc.parse(gzip.decompress(one.conversion))
    assert m["warc-refers-to"] == c["warc-refers-to"] == one.response_id and c["warc-type"] == "conversion" and one.source_digest_ok
    assert text.decode() == "One\ntwo\nl" and b"outlink: /q?a=1&b=2\r\n" in fields and b"title: T & x" in fields and b"http-header-content-type: text/html" in fields
    assert one.source_payload_digest == warc.sha1(html.encode())
    back = warc.build(df).toPandas()
    assert len(back) == 4 and (back.metadata_refers_to == back.response_id).all() and back[back.page_id == 2].target_uri.tolist() == ["urn:page:2"]
    assert warc.build(none(spark, "page_id long, url string, html string")).count() == 0


def test_license_scan(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it, please, under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    texts = [None, "", "Released under the MIT License. Also under the MIT-License", "x Apache_License Version 2", "CC-BY-NC", " ".join(words(40, 1)) + " " + gpl + " " + " ".join(words(40, 2)), " ".join(words(500, 3)), "free software under the terms of the GNU General Public License"]
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for doc, text in ((r.doc_id, r.text) for r in df.collect()):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
    assert got[35].labels == "gpl-3" and got[35].score > 0.8 and got[42].labels == "" and got[49].labels == ""
    assert license_scan.scan(none(spark)).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").collect()
    deduped = corpus_pipeline.minhash_stage(spark, docs, small)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in kept} == {i for i, v in _brute_minhash(rows).items() if v[2]}
    assert {r.doc_id for r in deduped.collect()} == {i for i, v in _brute_minhash(rows, 80).items() if v[2]}  # stages link at 0.8
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == columns, name
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted((r.start, r.n_tokens) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_fingerprint_of_kept_text(spark, small):
    r = queries.op3_substring_dedup(spark, small).first()
    assert len(r.kept_sha256) == 64 and hashlib.sha256(b"").hexdigest() != ""


def test_mixed_repeats_rows_without_ids_and_clashing_columns(spark):
    rows = [(k if k % 7 else None, " ".join(["w"] * (k % 13)), f"s{k % 3}", k, k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int, n int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = defaultdict(int)
    for r in mixing.mix(df).collect():
        copies[r.doc_id] = max(copies[r.doc_id], r.copies)
    assert out.count() == sum(copies[r[0]] for r in rows) and out.filter("doc_id is null").count() > 0


def test_mixing_ranks_do_not_depend_on_partitions(spark):
    df = _mixing_docs(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, mixing.mix(df.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]


def test_leaks_of_blank_items_and_items_without_ids(spark):
    df = docs_of(spark, [" ".join(words(30, 60)), None])
    blank = spark.createDataFrame([(1, "\t\n"), (2, " ")], "item_id long, text string")
    assert decontam.leaks(df, blank).count() == 0
    bench = spark.createDataFrame([(None, " ".join(words(30, 60))), (None, None), (4, " ".join(words(30, 61)))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()] == [(0, None)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from hexflow.llm import scratch

    def session(master, conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master))

    assert scratch.shared_dir(session("spark://x", {"spark.checkpoint.dir": "hdfs://y/z/"})) == "hdfs://y/z"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master, {}))
