"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Items (in pieces of ``piece_words`` words) are indexed with BM25 weights divided by the piece's own
best score, so a score is the share of a piece's BM25 mass that a passage holds and one threshold
serves all.  Passages are pairs of adjoining blocks of a document, long enough that a piece always
lies whole in one of them.  A piece's frequent terms, ``common_mass`` of its mass, are granted to
every passage; passages whose rare terms don't make up the rest of the threshold for any piece are
passed over.  The others run block-max WAND, which returns all pieces above the threshold.  Retrieved items
are then checked for question and answer overlap by shared word shingles.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.scratch import Scratch
from hexflow.llm.text import slices, split_words

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, item_overlap double"


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    shingle: int = 5
    #: Share of an item's words inside shared shingles, and of its question's and answer's alone.
    overlap: float = 0.8
    part_overlap: float = 0.5
    piece_words: int = 128
    #: Share of a piece's mass, in its most frequent terms, that the upper bound grants every passage.
    common_mass: float = 0.2
    postings_block: int = 32
    #: Items are indexed and broadcast in shards of this many bytes of text at most.
    shard_bytes: int = 16 << 20


def item_words(text: str | None) -> list[str]:
    words = split_words(pa.array([text], pa.string()), lower=True)
    vocab = [w.strip(_EDGES) or w for w in words.vocab.to_pylist()]
    return [vocab[c] for c in words.codes]


def answer_start(text: str | None) -> int:
    """Words before the last sentence, which counts as the answer; a single sentence is cut at two thirds."""
    words = (text or "").split()
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    return ends[-1] if ends else -(-2 * len(words) // 3)


class Index:
    """Postings by term with list and block maxima; ``df`` and ``n``, ``mean`` describe all pieces of all shards."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, s: Settings):
        self.s = s
        self.items = [(i, item_words(t), answer_start(t)) for i, t in items]  # item_id may be null
        self.pieces: list[int] = []
        weights: list[dict[str, float]] = []
        for at, (_, words, _) in enumerate(self.items):
            for a in range(0, len(words), s.piece_words):
                piece = Counter(words[a : a + s.piece_words])
                size = sum(piece.values())
                w = {}
                for term, tf in piece.items():
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    w[term] = idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * size / mean))
                total = sum(w.values())
                weights.append({t: x / total for t, x in w.items()})
                self.pieces.append(at)
        self.stride = max([32, *(min(len(w), s.piece_words) for _, w, _ in self.items)])
        self.terms = {t: k for k, t in enumerate(sorted({t for w in weights for t in w}))}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for p, w in enumerate(weights):
            for t, x in w.items():
                lists[self.terms[t]].append((p, x))
        self.postings = [([p for p, _ in lists[k]], [x for _, x in lists[k]]) for k in range(len(self.terms))]
        self.top = np.array([max(x) for _, x in self.postings] or [0.0])
        size = s.postings_block
        self.block_top = [[max(x[a : a + size]) for a in range(0, len(x), size)] for _, x in self.postings]
        held: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.need = np.zeros(len(weights))
        for p, w in enumerate(weights):
            rest = 1.0
            for t in sorted(w, key=lambda t: (df[t], t)):
                if rest <= s.common_mass:
                    break
                held[self.terms[t]].append((p, w[t]))
                rest -= w[t]
            self.need[p] = s.threshold - max(rest, 0.0)
        self.held_from = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
        self.held_piece = np.array([p for x in held for p, _ in x], dtype=np.int64)
        self.held_weight = np.array([v for x in held for _, v in x])
        self.grams = []
        for _, words, _ in self.items:
            ids = [self.terms[w] for w in words]
            width = min(s.shingle, len(ids)) or 1
            grams: dict[tuple, list[int]] = defaultdict(list)
            for a in range(len(ids) - width + 1):
                grams[tuple(ids[a : a + width])].append(a)
            self.grams.append((width, dict(grams)))

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """All pieces whose score for the distinct ``terms`` reaches the threshold, by block-max WAND."""
        least, size = self.s.threshold - 1e-12, self.s.postings_block
        lists = [[*self.postings[t], 0, float(self.top[t]), self.block_top[t]] for t in terms]
        found = []
        while True:
            lists = [c for c in lists if c[2] < len(c[0])]
            lists.sort(key=lambda c: c[0][c[2]])
            total, pivot = 0.0, -1
            for at, c in enumerate(lists):
                total += c[3]
                if total >= least:
                    pivot = at
                    break
            if pivot < 0:
                return found
            piece = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == piece:
                pivot += 1
            bound, edge = 0.0, lists[pivot + 1][0][lists[pivot + 1][2]] if pivot + 1 < len(lists) else math.inf
            for c in lists[: pivot + 1]:
                block = c[2] // size
                while (block + 1) * size < len(c[0]) and c[0][min((block + 1) * size, len(c[0])) - 1] < piece:
                    block += 1
                bound += c[4][block]
                last = c[0][min((block + 1) * size, len(c[0])) - 1]
                edge = min(edge, last + 1) if last >= piece else edge
            if bound < least:
                for c in lists[: pivot + 1]:  # no piece before the edge can reach the threshold
                    self._seek(c, max(edge, piece + 1))
            elif lists[0][0][lists[0][2]] == piece:
                score = 0.0
                for c in lists[: pivot + 1]:
                    score += c[1][c[2]]
                    c[2] += 1
                if score >= least:
                    found.append((piece, score))
            else:
                for c in lists[: pivot + 1]:
                    self._seek(c, piece)

    def _hopeful(self, block: np.ndarray, term: np.ndarray, block_owner: np.ndarray) -> np.ndarray:
        """First blocks of the passages whose rare terms leave some piece a chance to reach the threshold."""
        n_terms = len(self.terms)
        held = np.append(np.diff(self.held_from), 0)
        rare = np.flatnonzero(held[term] > 0)
        pairs = np.unique(block[rare] * np.int64(n_terms + 1) + term[rare])
        blocks, terms = pairs // (n_terms + 1), pairs % (n_terms + 1)
        sizes = held[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(self.held_from[terms] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        piece, weight, first = self.held_piece[at], self.held_weight[at], np.repeat(blocks, sizes)
        also = (first > 0) & (block_owner[first - 1] == block_owner[first])  # the passage that begins a block earlier
        keys = np.concatenate((first, first[also] - 1)) * np.int64(len(self.need)) + np.concatenate((piece, piece[also]))
        found, inverse = np.unique(keys, return_inverse=True)
        mass = np.bincount(inverse, weights=np.concatenate((weight, weight[also])), minlength=len(found))
        return np.unique(found[mass >= self.need[found % len(self.need)] - 1e-9] // len(self.need))

    @staticmethod
    def _seek(c: list, piece: float) -> None:
        while c[2] < len(c[0]) and c[0][c[2]] < piece:
            c[2] += 1

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, best score, overlaps) of the confirmed items of every text."""
        s = self.s
        words = split_words(texts, lower=True)
        ids = np.array([self.terms.get(w.strip(_EDGES) or w, -1) for w in words.vocab.to_pylist()] or [-1], dtype=np.int64)
        term = ids[words.codes]
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        blocks_of = -(-words.counts // self.stride)
        first_block = np.concatenate(([0], np.cumsum(blocks_of)))
        block = first_block[owner] + (np.arange(len(term)) - words.starts[owner]) // self.stride
        block_owner = np.repeat(np.arange(len(words.counts)), blocks_of)
        best: dict[tuple[int, int], float] = {}
        cover: dict[tuple[int, int], np.ndarray] = {}
        for k in self._hopeful(block, term, block_owner):
            doc = block_owner[k]
            a = words.starts[doc] + (k - first_block[doc]) * self.stride
            z = min(a + 2 * self.stride, words.starts[doc + 1])
            terms = np.unique(term[a:z])
            for piece, score in self.above(terms[terms >= 0].tolist()):
                key = (int(doc), self.pieces[piece])
                best[key] = max(score, best.get(key, 0.0))
                width, grams = self.grams[key[1]]
                seen = cover.setdefault(key, np.zeros(len(self.items[key[1]][1]), bool))
                around = term[max(a - self.stride, words.starts[doc]) : min(z + self.stride, words.starts[doc + 1])].tolist()
                for g in {tuple(around[i : i + width]) for i in range(len(around) - width + 1)}:
                    for at in grams.get(g, ()):
                        seen[at : at + width] = True
        out = []
        for (doc, item), seen in cover.items():
            cut = self.items[item][2]
            question = float(seen[:cut].mean()) if cut else 1.0
            answer = float(seen[cut:].mean()) if cut < len(seen) else 1.0
            if seen.mean() >= s.overlap and min(question, answer) >= s.part_overlap:
                out.append((doc, item, best[doc, item], question, answer, float(seen.mean())))
        return out


def _shards(items: DataFrame, s: Settings) -> Iterator[Index]:
    """One index of at most ``shard_bytes`` of text at a time, weighted by the statistics of all items."""
    items = items.select("item_id", "text").filter("length(trim(text)) > 0")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if not total:
        return
    n_shards = max(1, -(-total // s.shard_bytes))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = [], []
            for text in batch.column("text").to_pylist():
                all_words = item_words(text)
                for a in range(0, len(all_words), s.piece_words):
                    piece = all_words[a : a + s.piece_words]
                    keys += [*sorted(set(piece)), None]
                    n += [*[1] * len(set(piece)), len(piece)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["term", "n"])

    scratch = Scratch(items.sparkSession, "decontam")
    stats = scratch.save(items.select("text").mapInArrow(pieces, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("rows")), "terms")
    whole = stats.filter("term is null").first()
    if whole is None:  # items of tabs and line ends alone
        return
    for k in range(n_shards):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)) == k).collect()
        mine = sorted(((r["item_id"], r["text"]) for r in mine), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        used = {w for _, t in mine for w in item_words(t)}
        if n_shards == 1:
            df = {r["term"]: r["df"] for r in stats.filter("term is not null").collect()}
        else:
            wanted = items.sparkSession.createDataFrame([(w,) for w in sorted(used)], "term string")
            df = {r["term"]: r["df"] for r in stats.join(wanted, "term").collect()}
        yield Index(mine, df, whole["rows"], whole["df"] / whole["rows"], s)
    scratch.drop("terms")


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, item_overlap): every item found in a document.

    Words are lower-cased (A-Z), cut at ASCII white space and stripped of outer ASCII punctuation.
    Null or empty texts leak nothing, null, empty or blank items match nothing; an empty table on either
    side gives an empty result.  Items and documents without an id are searched like others and reported
    with a null id.  Repeated items and repeated rows are reported each; extra columns are ignored.
    Benchmarks larger than ``shard_bytes`` are searched shard by shard over all documents.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    out = None
    for index in _shards(items, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[doc], shared.value.items[item][0], *rest) for doc, item, *rest in shared.value.leaks(part.column("text"))]
                    cols = list(zip(*rows, strict=True)) or [[]] * 6
                    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap"]
                    )

        found = texts.mapInArrow(run, RESULT)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` in which no item was found; rows with a null doc_id stay."""
    return docs.join(leaks(docs, items, s).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
