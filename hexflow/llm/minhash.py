"""Near-duplicate documents by fast similarity sketches.

A sketch has ``t`` coordinates.  Round r throws every shingle into a bin by a fresh hash and an
empty bin takes the smallest value thrown into it; the first t rounds choose bins by hash, round
t + i throws everything into bin i, so every coordinate fills within 2t rounds and long documents
stop after a few.  Two sketches agree in a coordinate with probability equal to the Jaccard
similarity, with concentration as for independent coordinates.  Bands of ``rows`` coordinates give
candidate buckets; candidates pass a sketch estimate far below the threshold and are then
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.components import components
from hexflow.llm.scratch import Scratch, files_for
from hexflow.llm.text import mix, ngram_hashes, slices, split_words


@dataclass(frozen=True)
class MinHash:
    """Parameters.  A pair at the threshold is missed by all bands with probability (1 - s^rows)^bands (1e-6)."""

    shingle: int = 5
    percent: int = 85
    rows: int = 8
    bands: int = 43
    #: A pair at the threshold has a lower estimate with probability under 1e-9.
    estimate: float = 0.72
    #: Members of a bucket that are compared with one another in one piece.
    block: int = 128

    @property
    def t(self) -> int:
        return self.rows * self.bands


#: Documents whose rows share a file of a table that is made without their texts.
_DOCS = 8192

#: For a similarity of 0.8: a pair at the threshold is missed with probability 9.3e-7, estimated too low with 1.3e-11.
STAGE = MinHash(percent=80, rows=7, bands=59, estimate=0.66)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, flat, and the texts' offsets into them."""
    words = split_words(texts, lower=True)
    h = words.hashes()
    grams = ngram_hashes(h, n)
    sets = []
    for i, (a, b) in enumerate(zip(words.starts[:-1], words.starts[1:], strict=True)):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(ngram_hashes(h[a:b], int(b - a)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def sketch(flat: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of the sets, one row of t values each (all ones for an empty set)."""
    n = len(offsets) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, t), empty, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    values = flat
    for r in range(2 * t):
        if not len(values):
            break
        x = mix(values ^ mix(np.array([r + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
        bins = ((x >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if r < t else np.full(len(x), r - t)
        thrown = np.full((n, t), empty, dtype=np.uint64)
        np.minimum.at(thrown.reshape(-1), owner * t + bins, mix(x + np.uint64(r)))
        out = np.where(out == empty, thrown, out)
        open_ = (out == empty).any(axis=1)
        if not open_.all():
            keep = open_[owner]
            owner, values = owner[keep], values[keep]
    return out


def _signatures(p: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                flat, offsets = shingle_sets(part.column("text"), p.shingle)
                sizes = np.diff(offsets)
                prints = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat * np.uint64(2) + np.uint64(salt)), dtype=np.uint64)))
                    prints.append(mix((total[offsets[1:]] - total[offsets[:-1]]) ^ sizes.astype(np.uint64)).view(np.int64))
                bands, bytes_ = [], []
                for a in range(0, part.num_rows, 256):
                    z = min(a + 256, part.num_rows)
                    s = sketch(flat[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], p.t)
                    bytes_ += [row.tobytes() for row in (s & np.uint64(255)).astype(np.uint8)]
                    b = np.zeros((z - a, p.bands), dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64)
                    for k in range(p.rows):
                        b = mix(b * np.uint64(0xD6E8FEB86659FD93) + s.reshape(z - a, p.bands, p.rows)[:, :, k])
                    bands.append(b.view(np.int64))
                flat_bands = np.concatenate(bands).reshape(-1) if bands else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes),
                        pa.array(prints[0]),
                        pa.array(prints[1]),
                        pa.array(bytes_, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * p.bands), pa.array(flat_bands)),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sketch", "bands"],
                )

    return run


def _passes_estimate(p: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, p.t) for c in ("sketch_a", "sketch_b"))
            keep = pa.array((sa == sb).mean(axis=1) >= p.estimate)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _confirmed(p: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b", 4 << 20):
                keep = np.zeros(part.num_rows, dtype=bool)
                fa, oa = shingle_sets(part.column("text_a"), p.shingle)
                fb, ob = shingle_sets(part.column("text_b"), p.shingle)
                for i in range(part.num_rows):
                    x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= p.percent * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _block_links(p: MinHash):
    """Confirmed links between different components inside each run of equal keys of a sorted partition.

    A link whose ends the run has joined already says nothing new about components and is left out.
    A pair is confirmed in the first bucket it shares; that is read off the keys of the buckets, as
    the short sketch can agree in a band by chance.
    """

    def compare(rows: list[tuple], out_a: list[int], out_b: list[int]) -> None:
        (_, i_, j_), band = rows[0][0], rows[0][5]
        docs = np.array([r[1] for r in rows])
        comp = np.array([r[2] for r in rows])
        side = np.array([r[3] for r in rows])
        s = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, p.t)
        keys = np.array([r[7] for r in rows], dtype=np.int64)
        sets: dict[int, np.ndarray] = {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_sets(pa.array([rows[k][6]], pa.string()), p.shingle)[0]
            return sets[k]

        left, right = np.flatnonzero(side == i_), np.flatnonzero(side == j_)
        for i in left:
            js = right if i_ != j_ else right[right > i]
            js = js[comp[js] != comp[i]]
            if not len(js):
                continue
            js = js[(s[js] == s[i]).mean(axis=1) >= p.estimate]
            if not len(js):
                continue
            first = (keys[js] == keys[i]).argmax(axis=1)
            for j in js[first == band]:
                if comp[i] == comp[j]:
                    continue
                x, y = shingles(i), shingles(j)
                if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= p.percent * (len(x) + len(y) - both):
                    out_a.append(int(min(docs[i], docs[j])))
                    out_b.append(int(max(docs[i], docs[j])))
                    comp[comp == comp[j]] = comp[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out_a: list[int] = []
        out_b: list[int] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "doc_id", "component", "blk", "sketch", "band", "text", "bands")]
            for bucket, i, j, doc, comp, blk, sk, band, text, bands in zip(*cols, strict=True):
                key = (bucket, i, j)
                if held and held[0][0] != key:
                    compare(held, out_a, out_b)
                    held.clear()
                held.append((key, doc, comp, blk, sk, band, text, bands))
        if held:
            compare(held, out_a, out_b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(p), "a long, b long")


def _star(pairs: DataFrame, reps: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """The confirmed links among ``pairs`` (a, b), a being the head of b's bucket."""
    a, b = (reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    likely = pairs.distinct().join(a, "a").join(b, "b").filter(f"100 * least(n_a, n_b) >= {p.percent} * greatest(n_a, n_b)")
    likely = likely.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_passes_estimate(p), "a long, b long")
    return _confirm(likely, texts, p)


def _cells(members: DataFrame, of: DataFrame, p: MinHash) -> DataFrame:
    """(bucket, i, j, doc_id, component, band, blk): what is still to compare, in pieces of about ``block`` by ``block``.

    A bucket whose members lie in several components sends the members outside its largest one
    (blocks i) against all its members (blocks j, numbered after them); up to ``block`` members are
    one piece.
    """
    rest = members.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("component")).alias("low"))).alias("top"), F.count("*").alias("components")).filter("components > 1")
    split = split.select("bucket", (-F.col("top.low")).alias("largest"), F.ceil(F.col("all") / p.block).alias("nj"), F.ceil((F.col("all") - F.col("top.n")) / p.block).alias("ni"))
    rest = rest.select("bucket", "doc_id", "component", "band").join(split, "bucket").withColumn("apart", F.col("component") != F.col("largest"))
    one = rest.filter("nj = 1").withColumns({c: F.lit(0).cast("long") for c in ("i", "j", "blk")})
    rest = rest.filter("nj > 1")
    i, j = F.pmod(F.xxhash64("doc_id"), F.col("ni")), F.col("ni") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("nj"))
    asked = rest.filter("apart").withColumn("i", i).withColumn("j", F.explode(F.expr("sequence(ni, ni + nj - 1)"))).withColumn("blk", F.col("i"))
    against = rest.withColumn("j", j).withColumn("i", F.explode(F.expr("sequence(0L, ni - 1)"))).withColumn("blk", F.col("j"))
    return one.unionByName(asked).unionByName(against).drop("largest", "ni", "nj", "apart")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; either may be null).

    Words are lower-cased (A-Z) and cut at ASCII white space; a document's set is its distinct
    ``shingle``-word shingles, the whole sequence if it is shorter, empty without words.  Documents
    link when 100 * intersection >= percent * union; an empty set links with nothing.  Rows without
    a doc_id link with nothing, have no component and are kept; rows that share a doc_id are one
    document, linked by any of its texts.  Extra columns are ignored; an empty table gives an empty
    result.

    Equal sets are one class, so thousands of copies cost one comparison.  In every bucket all
    classes are compared with the bucket's smallest, and those that it doesn't link with the smallest
    of them.  Where a bucket's members still lie in several components, those outside the largest
    are compared with all members in blocks: no bucket is capped and none is held whole.

    Tables lie in as many files as their documents need.  Steps that read texts keep all their tasks;
    the links they find, two numbers each, are then dealt to those files.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    sig = scratch.save(docs.select("doc_id", "text").mapInArrow(_signatures(p), "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary, bands array<long>"), "signatures")
    files = files_for(sig.count(), _DOCS)
    classes = scratch.save(sig.filter("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "sets", files=files)
    reps = scratch.save(sig.select("doc_id", "sketch", "bands").join(classes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id"), "classes", files=files)

    pool = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    buckets = pool.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("members")).filter("members > 1")
    members = scratch.save(pool.join(buckets, "bucket"), "members", files=files)
    first = scratch.save(_star(members.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")), reps, texts, p).repartition(files), "links-1")

    unlinked = members.filter("members > 2 and doc_id <> head").join(first.select(F.col("a").alias("head"), F.col("b").alias("doc_id")), ["head", "doc_id"], "left_anti").select("bucket", "doc_id")
    unlinked = scratch.save(unlinked, "unlinked", files=files)
    heads = unlinked.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    second = unlinked.join(heads, "bucket").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    links = scratch.save(first.union(_star(second, reps, texts, p)).repartition(files), "links-2")

    cells = _cells(members, components(scratch, links, "star"), p).join(reps.select("doc_id", "sketch", "bands"), "doc_id").join(texts, "doc_id")
    more = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_block_links(p), "a long, b long")
    all_links = scratch.save(links.union(more).repartition(files), "links")
    scratch.drop("members", "unlinked", "links-1", "links-2")
    of = components(scratch, all_links, "all")

    # A table of its own, so that a class of very many copies is a skewed join that Spark splits.
    by_class = scratch.save(classes.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "by-class", files=files)
    out = sig.select("doc_id", "n_shingles", "fp1", "fp2").join(by_class, ["fp1", "fp2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result", files=files)
    scratch.drop("signatures", "sets", "classes", "links", "by-class")
    return out
