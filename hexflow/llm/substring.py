"""Removal of repeated passages by fixed-block anchors.

Every document is an index of non-overlapping blocks of ``(window + 1) // 2`` words, so any window
of ``window`` words holds one whole block of the document it is taken from.  Every rolling window
of block length probes the index.  Hits are extended: each ``window``-word stretch around a hit is
looked up among all such stretches, which yields the smallest document that has it, and adjoining
stretches merge into maximal repeats.

Documents travel in chunks of a few MB.  Probes and blocks of a chunk go to hash buckets as packed
sorted arrays, each distinct one once per chunk, so a passage that a third of all documents share
costs one entry per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hexflow.llm.scratch import Scratch
from hexflow.llm.text import Words, ngram_hashes, slices, split_words, within

_LOW = np.uint64((1 << 40) - 1)
_BUCKET_ROWS = "bucket long, chunk long, payload binary"
#: Rows of some MB each: row groups are closed after a few of them, or writers and readers would hold a hundred at once.
_FEW_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(payload: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = len(raw) // sum(np.dtype(d).itemsize for d in dtypes)
    out, at = [], 0
    for d in dtypes:
        out.append(np.frombuffer(raw, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def _to_chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                one = pa.array([0, part.num_rows], pa.int32())
                chunk += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(one, pa.concat_arrays([part.column("doc_id")])), pa.ListArray.from_arrays(one, pa.concat_arrays([part.column("text")]))],
                    ["chunk", "doc_ids", "texts"],
                )

    return run


def _documents(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    ids, texts = (batch.column(c).slice(i, 1).flatten() for c in ("doc_ids", "texts"))
    return pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])


def _chunk_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, its documents) of a batch of the chunk table."""
    for i in range(batch.num_rows):
        yield batch.column("chunk")[i].as_py(), _documents(batch, i)


def _with_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[list[tuple[int, bytes]]]]]:
    """(chunk, its documents, the replies of each round) of rows sorted by chunk and round, a chunk's documents first: one chunk is held at a time."""
    held: tuple[int, pa.RecordBatch, list[list[tuple[int, bytes]]]] | None = None
    for batch in batches:
        chunks, rounds, buckets = (batch.column(c).to_pylist() for c in ("chunk", "round", "bucket"))
        for i, (chunk, r) in enumerate(zip(chunks, rounds, strict=True)):
            if r == 0:
                if held:
                    yield held
                held = chunk, _documents(batch, i), [[], []]
            else:
                held[2][r - 1].append((buckets[i], batch.column("payload")[i].as_py()))
    if held:
        yield held


def _owners(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.counts)), words.counts)


def _by_bucket(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every bucket in sorted ``values``, buckets being their ``bits`` highest bits."""
    tops = (values >> np.uint64(64 - bits)).astype(np.int64)
    return np.searchsorted(tops, np.arange(1 << bits)), np.searchsorted(tops, np.arange(1 << bits), side="right")


def _probes_and_blocks(anchor: int, bits: int):
    """Per chunk and bucket: distinct probes, whether two documents hold them, whether they are a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in _chunk_rows(batch):
                words = split_words(docs.column("text"))
                g = ngram_hashes(words.hashes(), anchor)
                at = np.flatnonzero(within(words.starts, anchor))
                owner = _owners(words)[at]
                block = (at - words.starts[:-1][owner]) % anchor == 0
                order = np.argsort(g[at], kind="stable")
                values, owner, block = g[at][order], owner[order], block[order]
                if not len(values):
                    continue
                first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
                several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                is_block = np.maximum.reduceat(block, first)
                distinct = values[first]
                flags = several.astype(np.uint8) + 2 * is_block.astype(np.uint8)
                inside = (distinct >> np.uint64(64 - bits - 40)) & _LOW
                lo, hi = _by_bucket(distinct, bits)
                full = np.flatnonzero(hi > lo)
                payloads = [_pack((v := inside[lo[b] : hi[b]]).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint8), flags[lo[b] : hi[b]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), chunk)), pa.array(payloads, pa.binary())], ["bucket", "chunk", "payload"])

    return run


def _bucketwise(work: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]):
    """Applies ``work`` to the rows of each bucket of a partition sorted by bucket."""

    def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            for bucket, chunk, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "payload")), strict=True):
                if bucket != now and held:
                    yield out([(now, c, p) for c, p in work(held)])
                    held = []
                now = bucket
                held.append((chunk, payload))
        if held:
            yield out([(now, c, p) for c, p in work(held)])

    return run


def _hits(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """To every chunk, those of its probes that meet a block and lie in two documents or more."""
    parts = [(c, *_unpack(p, "u4", "u1", "u1")) for c, p in rows]
    values = [low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) for _, low, high, _ in parts]
    distinct, inverse = np.unique(np.concatenate(values), return_inverse=True)
    flags = np.concatenate([f for *_, f in parts])
    docs = np.bincount(inverse, weights=1 + (flags & 1), minlength=len(distinct))
    block = np.bincount(inverse, weights=flags >> 1, minlength=len(distinct)) > 0
    hot = (docs >= 2) & block
    at = 0
    for (chunk, low, high, _), _v in zip(parts, values, strict=True):
        keep = hot[inverse[at : at + len(low)]]
        at += len(low)
        if keep.any():
            yield chunk, _pack(low[keep], high[keep])


def _smallest(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """To every chunk, the smallest document of each of its stretches, in the chunk's order."""
    parts = [(c, *_unpack(p, "u8", "u8", "i8")) for c, p in rows]
    values, checks, docs = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
    _, _, inverse, low = _distinct_stretches(values, checks, docs)
    at = 0
    for chunk, v, *_ in parts:
        yield chunk, _pack(low[inverse[at : at + len(v)]])
        at += len(v)


def _stretches(words: Words, ids: np.ndarray, replies: list[tuple[int, bytes]], window: int, anchor: int, bits: int):
    """Starts of the windows around hits, two hashes of each and their documents' ids."""
    h = words.hashes()
    g = ngram_hashes(h, anchor)
    shift = np.uint64(64 - bits - 40)
    hot = [np.empty(0, np.uint64)]
    for bucket, payload in replies:
        low, high = _unpack(payload, "u4", "u1")
        hot.append((np.uint64(bucket) << np.uint64(40)) | (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64))
    hot = np.sort(np.concatenate(hot))
    short = g >> shift
    where = np.minimum(np.searchsorted(hot, short), max(len(hot) - 1, 0))
    hit = (hot[where] == short) if len(hot) else np.zeros(len(g), bool)
    count = np.concatenate(([0], np.cumsum(hit)))
    ok = within(words.starts, window)
    start = np.arange(len(ok))
    near = count[start + window - anchor + 1] > count[start]
    at = np.flatnonzero(ok & near)
    return at, ngram_hashes(h, window)[at], ngram_hashes(words.hashes(1), window)[at], ids[_owners(words)[at]]


def _distinct_stretches(values: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of hashes in order, each stretch's place among them, and the smallest document of each."""
    order = np.lexsort((checks, values))
    values, checks = values[order], checks[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (checks[1:] != checks[:-1])
    first = np.flatnonzero(new)
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return values[first], checks[first], inverse, np.minimum.reduceat(docs[order], first) if len(first) else docs[:0]


def _ids(docs: pa.RecordBatch) -> np.ndarray:
    """The documents' ids, the largest number for those without: a text without an id is never the first to hold a window, and keeps none that another holds."""
    return pc.fill_null(docs.column("doc_id"), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _extend(window: int, anchor: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, (hits, _) in _with_replies(batches):
            if not hits:
                continue
            words = split_words(docs.column("text"))
            _, values, checks, owners = _stretches(words, _ids(docs), hits, window, anchor, bits)
            if not len(values):
                continue
            distinct, checks, _, low = _distinct_stretches(values, checks, owners)
            lo, hi = _by_bucket(distinct, bits)
            full = np.flatnonzero(hi > lo)
            payloads = [_pack(distinct[lo[b] : hi[b]], checks[lo[b] : hi[b]], low[lo[b] : hi[b]]) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), chunk)), pa.array(payloads, pa.binary())], ["bucket", "chunk", "payload"])

    return run


def _remove(window: int, anchor: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, (hits, lows) in _with_replies(batches):
            words = split_words(docs.column("text"))
            ids = _ids(docs)
            cover = np.zeros(len(words.codes) + 1, dtype=np.int64)
            if hits:
                at, values, checks, owners = _stretches(words, ids, hits, window, anchor, bits)
                *_, inverse, _ = _distinct_stretches(values, checks, owners)
                low = np.concatenate([_unpack(p, "i8")[0] for _, p in sorted(lows)] or [np.empty(0, np.int64)])
                gone = at[low[inverse] < owners]
                np.add.at(cover, gone, 1)
                np.add.at(cover, np.minimum(gone + window, len(cover) - 1), -1)
            removed = np.cumsum(cover[:-1]) > 0
            vocab = np.array(words.vocab.to_pylist() or [""], dtype=object)
            texts, spans, gone_counts = [], [], []
            for a, b in zip(words.starts[:-1], words.starts[1:], strict=True):
                off = removed[a:b]
                texts.append(" ".join(vocab[words.codes[a:b][~off]].tolist()))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], off.astype(np.int8), [0]))))
                spans.append([{"start": int(s), "words": int(e - s)} for s, e in edge.reshape(-1, 2)])
                gone_counts.append(int(off.sum()))
            yield pa.RecordBatch.from_arrays(
                [docs.column("doc_id"), pa.array(words.counts), pa.array(gone_counts, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed_spans) for every row of ``docs`` (doc_id, text).

    Words are cut at ASCII white space and not changed.  A word goes if a window of ``window``
    words over it also starts in a document with a smaller doc_id; windows are judged on the input.
    Repeats inside one document alone stay, and so do those among rows that share a doc_id.  Rows
    without a doc_id come after all others.  A null or empty text has no words and gives an empty
    kept text; texts shorter than a window are kept.  Extra columns are ignored; an empty table
    gives an empty result.  Stretches are compared by two 64-bit hashes of differently seeded word hashes.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    anchor = (window + 1) // 2
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(22, max(6, math.ceil(math.log2(max(size, 1) / (4 << 20))))) if size > 1 else 6
    chunks = scratch.save(docs.select("doc_id", "text").mapInArrow(_to_chunks(chunk_bytes), "chunk long, doc_ids array<long>, texts array<string>"), "chunks", options=_FEW_ROWS)
    # rounds of answers grow with the input, and so do the partitions that they are dealt to: a task's share stays the same
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // (8 << 20) + 1 if size < 1 << 50 else 1)

    def answered(sent: DataFrame, work, name: str) -> DataFrame:
        return scratch.save(sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucketwise(work), _BUCKET_ROWS), name)

    def met(*rounds: DataFrame) -> DataFrame:
        """Chunks and their replies, each chunk's rows after one another: documents, then the rounds in order."""
        none = "cast(null as array<long>) as doc_ids", "cast(null as array<string>) as texts"
        rows = chunks.selectExpr("chunk", "0 as round", "cast(null as long) as bucket", "cast(null as binary) as payload", "doc_ids", "texts")
        for k, replies in enumerate(rounds, 1):
            rows = rows.unionAll(replies.selectExpr("chunk", f"{k} as round", "bucket", "payload", *none))
        return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "round")

    hits = answered(chunks.mapInArrow(_probes_and_blocks(anchor, bits), _BUCKET_ROWS), _hits, "hits")
    lows = answered(met(hits).mapInArrow(_extend(window, anchor, bits), _BUCKET_ROWS), _smallest, "lows")
    return met(hits, lows).mapInArrow(
        _remove(window, anchor, bits),
        "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,words:long>>",
    )
