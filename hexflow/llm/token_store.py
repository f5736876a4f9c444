"""Token ids in a content-addressed store.

Every document's id stream is cut where a rolling hash of the last ids has zero low bits, so equal
passages give equal chunks wherever they stand.  The store keeps three Parquet tables:

``chunks``    digest, n, ids (little-endian, 2 bytes an id if the vocabulary allows, else 4): each distinct chunk once
``recipes``   part, idx, doc_id, n_tokens, local_start, digests, counts, root: documents in ascending doc_id order
``manifest``  level, part, block, root: Merkle nodes over the documents' roots; the ``store`` level has one row

Reading back hashes every chunk again, compares the digests, and combines the chunks' CRCs into
the documents' (a CRC of a concatenation follows from the CRCs and lengths of its parts), so no
ids need to move to their documents.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.llm.scratch import Scratch, files_for
from hexflow.llm.text import mix, slices, split_words
from hexflow.session import ship_package

#: Pieces of words whose ids a Python worker keeps.
_CACHE_PIECES = 700_000
_tokenizers: dict[str, "Encoder"] = {}


@dataclass(frozen=True)
class Chunking:
    """A cut follows each window of ``window`` ids (a power of two) whose hash has ``bits`` zero bits, within the two bounds."""

    window: int = 16
    bits: int = 9
    least: int = 64
    most: int = 4096


class Encoder:
    """A tokenizer with the ids of the pieces met.

    Where the tokenizer cuts at white space and drops it, a text's ids are its words' ids in order,
    so each distinct word is encoded once.  Where it also lower-cases and cuts letters from other
    characters, a word of letters below U+0100 (already in normal form C) with perhaps one mark
    behind it has the ids of its lower-cased letters and those of the mark, so "word", "Word" and
    "word," share one piece.
    """

    _MARKS = ".,;:!?"
    _PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]?$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        shape = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        cut = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        # Fixed value: the pattern by which this family of tokenizers cuts words.
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cut[0].get("pattern", {}).get("Regex") == pattern and cut[0].get("invert") and cut[0].get("behavior") == "Removed"
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        letters = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}
        self.alphabet = [letters[b] for b in range(256)]  # the byte-level alphabet
        ids = np.arange(self.tokenizer.get_vocab_size(), dtype="<u4").tobytes()
        self.raw = [ids[k : k + 4] for k in range(0, len(ids), 4)]

    def _letters(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return b"".join([self.raw[t.id] for t in self.tokenizer.model.tokenize(shown)])

    def _ids(self, pieces: list[str], letters: int) -> list[bytes]:
        """The ids of each piece (distinct ones) as little-endian uint32 bytes; the first ``letters`` go to the model directly."""
        known = self.pieces
        out = [known.get(p) for p in pieces]
        new = [k for k, found in enumerate(out) if found is None]
        if len(known) + len(new) > _CACHE_PIECES:
            known.clear()
        cut = bisect.bisect_left(new, letters)
        for k in new[:cut]:
            out[k] = known[pieces[k]] = self._letters(pieces[k])
        for a in range(cut, len(new), 20_000):
            some = new[a : a + 20_000]
            encoded = self.tokenizer.encode([pieces[k] for k in some], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(encoded.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(encoded.word_ids, dtype=np.int64), np.arange(len(some)), side="right") * 4
            start = 0
            for k, end in zip(some, ends.tolist(), strict=True):
                out[k] = known[pieces[k]] = raw[start:end]
                start = end
        return out

    def table(self, vocab: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of ``vocab`` (distinct ones), flat, and the words' offsets into them."""
        plain = pc.match_substring_regex(vocab, self._PLAIN)
        words = vocab.filter(plain)
        bodies = pc.utf8_rtrim(words, self._MARKS)
        marked = pc.not_equal(pc.binary_length(words), pc.binary_length(bodies)).to_numpy(zero_copy_only=False)
        lowered = pc.utf8_lower(bodies).dictionary_encode()
        others = vocab.filter(pc.invert(plain)).to_pylist()
        table = self._ids([*lowered.dictionary.to_pylist(), *others, *self._MARKS], len(lowered.dictionary)) + [b""]
        first_mark = len(table) - 1 - len(self._MARKS)
        # every word is a piece and a mark, perhaps the empty one at the table's end
        is_plain = plain.to_numpy(zero_copy_only=False)
        both = np.full((len(vocab), 2), len(table) - 1, dtype=np.int64)
        both[is_plain, 0] = lowered.indices.to_numpy(zero_copy_only=False)
        both[~is_plain, 0] = len(lowered.dictionary) + np.arange(len(others))
        at = np.flatnonzero(is_plain)[marked]
        if len(at):
            mark_of = np.full(256, len(table) - 1, dtype=np.int64)
            mark_of[np.frombuffer(self._MARKS.encode(), np.uint8)] = first_mark + np.arange(len(self._MARKS))
            ends = np.frombuffer(vocab.buffers()[1], np.int32)[vocab.offset + 1 : vocab.offset + 1 + len(vocab)]
            both[at, 1] = mark_of[np.frombuffer(vocab.buffers()[2], np.uint8)[ends[at] - 1]]
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        ids, ends = _gathered(flat, np.cumsum(sizes) - sizes, sizes, both.reshape(-1))
        return ids, np.concatenate(([0], ends[1::2]))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that ``codes`` name, one after another, and their ends."""
    lens = sizes[codes]
    ends = np.cumsum(lens)
    at = np.repeat(starts[codes] - (ends - lens), lens)
    at += np.arange(len(at))
    return flat[at], ends


def encode(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, each closed by ``end_id``, and the texts' offsets into them."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    encoder = _tokenizers[path]
    if not encoder.by_word:
        encoded = encoder.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        offsets = np.concatenate(([0], np.cumsum([len(e.ids) + 1 for e in encoded]))).astype(np.int64)
        return np.array([i for e in encoded for i in (*e.ids, end_id)], dtype=np.uint32), offsets
    words = split_words(texts)
    flat, offsets = encoder.table(words.vocab)
    flat = np.append(flat, np.uint32(end_id))  # as a last word of every text
    codes = np.insert(words.codes, words.starts[1:], len(offsets) - 1)
    ids, ends = _gathered(flat, offsets, np.append(np.diff(offsets), 1), codes)
    return ids, np.concatenate(([0], ends[words.starts[1:] + np.arange(len(words.counts))]))


_STEPS = {1 << k: np.uint64(pow(0xD6E8FEB86659FD93, 1 << k, 1 << 64)) for k in range(16)}


def cuts(ids: np.ndarray, c: Chunking) -> list[int]:
    """Ends of the chunks of one document's ids (the last is their number)."""
    n = len(ids)
    g, span = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while span < c.window and len(g) > span:  # hashes of 1, 2, 4 ... ids
        g = g[:-span] * _STEPS[span] + g[span:]
        span *= 2
    marks = np.flatnonzero(mix(g) & np.uint64((1 << c.bits) - 1) == 0) + c.window if span >= c.window else np.empty(0, np.int64)
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > c.most:
            last += c.most
            out.append(last)
        if m - last >= c.least or m == n and m > last:
            out.append(m)
            last = m
    return out


def _encoded(path: str, end_id: int, wide: bool, c: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        occ = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 12 << 20):
                ids, offsets = encode(path, part.column("text"), end_id)
                stored = ids.astype("<u4" if wide else "<u2")
                docs = part.column("doc_id").to_pylist()
                rows: list[tuple] = []
                for doc, a, z in zip(docs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    start = a
                    for seq, end in enumerate(cuts(ids[a:z], c)):
                        raw = stored[start : a + end].tobytes()
                        digest = hashlib.blake2b(raw, digest_size=16).digest()
                        fresh = digest not in seen
                        if fresh:
                            if len(seen) >= 1_000_000:  # a chunk sent twice is stored once all the same
                                seen.clear()
                            seen.add(digest)
                        rows.append((doc, occ, seq, digest, a + end - start, raw if fresh else None))
                        start = a + end
                    occ += 1
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "occ", "seq", "digest", "n", "ids"])

    return run


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each digest of a partition sorted by digest."""
    last = None
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        keep = [d != p for d, p in zip(digests, [last, *digests[:-1]], strict=True)]
        last = digests[-1] if digests else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document of a partition sorted by (doc_id, occ, seq)."""
    part = TaskContext.get().partitionId()
    names = ["part", "idx", "doc_id", "n_tokens", "local_start", "digests", "counts", "root"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
    idx = start = 0
    now, digests, counts = None, [], []
    rows: list[tuple] = []

    def close() -> None:
        nonlocal idx, start
        n = sum(counts)
        rows.append((part, idx, now, n, start, digests, counts, hashlib.blake2b(b"".join(digests), digest_size=16).digest()))
        idx, start = idx + 1, start + n

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        for doc, seq, digest, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "digest", "n")), strict=True):
            if seq == 0 and digests:
                close()
            if seq == 0:
                now, digests, counts = doc, [], []
            digests.append(digest)
            counts.append(n)
        if rows:
            yield out()
    if digests:
        close()
    yield out()


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1, chunking: Chunking = Chunking()) -> str:
    """Encodes every whole text of ``docs`` (doc_id, text; null counts as empty) and returns the store's folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    wide = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) > 1 << 16
    staged = scratch.save(docs.select("doc_id", "text").mapInArrow(_encoded(tokenizer_path, end_id, wide, chunking), "doc_id long, occ long, seq int, digest binary, n long, ids binary"), "staged")
    once = staged.filter("ids is not null").select("digest", "n", "ids").repartition("digest").sortWithinPartitions("digest")
    scratch.save(once.mapInArrow(_first_of_run, "digest binary, n long, ids binary"), "chunks")
    ordered = staged.select("doc_id", "occ", "seq", "digest", "n").repartitionByRange("doc_id", "occ").sortWithinPartitions("doc_id", "occ", "seq")
    recipes = scratch.save(
        ordered.mapInArrow(_recipes, "part int, idx long, doc_id long, n_tokens long, local_start long, digests array<binary>, counts array<long>, root binary"), "recipes"
    )
    scratch.drop("staged")
    # one node for 1,024 documents and one for a part
    scratch.save(_manifest(recipes).repartition(files_for(recipes.count(), 1 << 20)), "manifest")
    return scratch.base


def _manifest(recipes: DataFrame) -> DataFrame:
    """Merkle nodes over blocks of 1,024 documents, over parts, and over the store."""

    def level(below: DataFrame, keys: list, order: list, name: str) -> DataFrame:
        kids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.hex("root").alias("root")))), lambda x: x["root"]), "")
        node = below.groupBy(*keys).agg(F.unhex(F.sha2(kids, 256)).alias("root"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        for c in ("part", "block"):
            node = node if c in node.columns else node.withColumn(c, F.lit(None).cast("long"))
        return node.select(F.lit(name).alias("level"), F.col("part").cast("long").alias("part"), F.col("block").cast("long").alias("block"), "n_docs", "n_tokens", "root")

    leaves = recipes.select("part", "idx", F.expr("idx div 1024").alias("block"), "root", "n_tokens", F.lit(1).cast("long").alias("n_docs"))
    blocks = level(leaves, ["part", "block"], ["idx"], "block")
    parts = level(blocks, ["part"], ["block"], "part")
    return blocks.union(parts).union(level(parts, [], ["part"], "store"))


def _shift_tables(powers: int = 48) -> np.ndarray:
    """For each k, byte-wise tables of the linear map that appends 2^k zero bytes to a CRC-32's message."""

    def apply(columns: list[int], v: int) -> int:
        out = 0
        for bit in range(32):
            if v >> bit & 1:
                out ^= columns[bit]
        return out

    columns = [0xEDB88320] + [1 << (b - 1) for b in range(1, 32)]  # one zero bit
    for _ in range(3):
        columns = [apply(columns, c) for c in columns]  # a byte
    tables = np.zeros((powers, 4, 256), dtype=np.uint32)
    for k in range(powers):
        for byte in range(4):
            for v in range(256):
                tables[k, byte, v] = apply(columns, v << (8 * byte))
        columns = [apply(columns, c) for c in columns]
    return tables


_tables: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each CRC-32 contributes when so many bytes follow; such contributions combine by xor."""
    if not _tables:
        _tables.append(_shift_tables())
    crc, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for k, table in enumerate(_tables[0]):
        on = (zeros >> k & 1).astype(bool)
        if on.any():
            v = crc[on]
            crc[on] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
        if not (zeros >> k).any():
            break
    return crc


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for digest, n, raw in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "ids")), strict=True):
            if hashlib.blake2b(raw, digest_size=16).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(crcs, pa.int64())], ["digest", "stored_n", "crc"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_shift(batch.column("crc").to_numpy(), batch.column("after").to_numpy() * 4)
        names = ["doc_id", "start", "n_tokens", "n_chunks", "stored_n"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc.astype(np.int64))], [*names, "crc"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [hashlib.blake2b(b"".join(d), digest_size=16).digest() for d in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "idx", "n_tokens")), pa.array(roots, pa.binary())], ["part", "idx", "n_tokens", "root"])


def verify_manifest(spark: SparkSession, store: str) -> None:
    """Builds all Merkle nodes again from the recipes' digests; a node that differs from the manifest is an error."""
    recipes = spark.read.parquet(f"{store}/recipes").select("part", "idx", "n_tokens", "digests")
    nodes = _manifest(recipes.mapInArrow(_rooted, "part int, idx long, n_tokens long, root binary"))
    sides = nodes.withColumn("side", F.lit(1)).union(spark.read.parquet(f"{store}/manifest").withColumn("side", F.lit(-1)))
    if not sides.groupBy(*nodes.columns).agg(F.sum("side").alias("off")).filter("off <> 0").isEmpty():
        raise ValueError("the recipes differ from the manifest")


def read_back(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; a damaged or missing chunk or recipe is an error."""
    ship_package(spark)
    verify_manifest(spark, store)
    recipes = spark.read.parquet(f"{store}/recipes")
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    begin = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = recipes.join(begin, "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "digests", "counts")
    after = F.expr("transform(counts, (c, i) -> aggregate(slice(counts, i + 2, size(counts)), 0L, (s, x) -> s + x))")
    each = placed.select("doc_id", "start", "n_tokens", F.size("digests").alias("n_chunks"), F.explode(F.arrays_zip("digests", after.alias("after"))).alias("x"))
    each = each.select("doc_id", "start", "n_tokens", "n_chunks", F.col("x.digests").alias("digest"), F.col("x.after").alias("after"))
    crcs = spark.read.parquet(f"{store}/chunks").mapInArrow(_checked, "digest binary, stored_n long, crc long")
    parts_ = each.join(crcs, "digest").select("doc_id", "start", "n_tokens", "n_chunks", "stored_n", "crc", "after")
    parts_ = parts_.mapInArrow(_shifted, "doc_id long, start long, n_tokens long, n_chunks int, stored_n long, crc long")
    out = parts_.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("stored_n").alias("got"), F.count("*").alias("found"), F.first("n_chunks").alias("n_chunks"))
    whole = F.when((F.col("got") == F.col("n_tokens")) & (F.col("found") == F.col("n_chunks")), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("the store lacks a chunk")))
    return out.select("doc_id", "start", "n_tokens", whole.cast("long").alias("ids_crc32"))


def documents_ids(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, ids array<int>): every document's ids, put together from its chunks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int32) for n, raw in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
            names = ["part", "idx", "doc_id", "seq"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"])

    ship_package(spark)
    recipes = spark.read.parquet(f"{store}/recipes").select("part", "idx", "doc_id", F.posexplode("digests").alias("seq", "digest"))
    pieces = recipes.join(spark.read.parquet(f"{store}/chunks"), "digest").select("part", "idx", "doc_id", "seq", "n", "ids")
    pieces = pieces.mapInArrow(decode, "part int, idx long, doc_id long, seq int, ids array<int>")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])
    return pieces.groupBy("part", "idx", "doc_id").agg(F.flatten(in_order).alias("ids")).select("doc_id", "ids")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``docs``, read back from a new store.

    ``start`` counts the ids of all documents with a smaller doc_id.  Null and empty texts hold the
    end id alone; an empty table gives an empty store and result; extra columns are ignored.
    Rows that share a doc_id (or have none) are documents of their own, in any order among themselves.
    """
    return read_back(docs.sparkSession, write_store(docs, tokenizer_path, end_id))
