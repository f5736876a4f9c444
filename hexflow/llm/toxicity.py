"""Toxicity scores from a convolutional text classifier, trained here in numpy.

A word's vector is the sum of three hashed embeddings: the word (A-Z lower-cased, outer punctuation
cut off) and its first and last characters.  Filters of one, two and three words slide over the
whole text, each keeps its maximum, and a logistic layer reads the maxima.  Scores are calibrated on
training rows that the fit has not seen; thresholds are then chosen per language.  The language is
used for thresholds alone and is no input of a score.

All labelled rows teach.  They are dealt to shards of bounded size; in an epoch each shard descends
from the common model, and the shards' models are averaged in steps, a word's embedding by the number
of a shard's texts that hold it.  Texts are dealt and cut into words once; a shard is then rows of
numbers in one row group, which every epoch reads where it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import groupby, islice, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from hexflow.llm.text import slices, split_words
from hexflow.session import ship_package
from hexflow.store import Scratch


@dataclass(frozen=True)
class Settings:
    #: If set, labelled rows that the classifier is fitted to, at most; chosen by a hash of doc_id.
    max_labelled: int | None = None
    #: If set, bytes of their texts, at most; rows beyond, in the order of that hash, teach nothing.
    max_bytes: int | None = None
    #: Rows and bytes of text of a shard, about; there are as many shards as all rows need.
    shard_rows: int = 16_000
    shard_bytes: int = 64 << 20
    #: Models that one task averages.
    merged: int = 8
    buckets: int = 1 << 16
    dim: int = 16
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    affix: int = 6
    epochs: int = 5
    batch: int = 32
    rate: float = 0.1
    #: Buckets met in fewer training texts stay zero.
    least_texts: int = 3
    seed: int = 7
    threshold: float = 0.3


@dataclass
class Model:
    settings: Settings
    embed: np.ndarray
    conv: list[np.ndarray]
    conv_bias: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_buckets(words: list[str], s: Settings) -> np.ndarray:
    """Three embedding rows of each word."""
    out, digest, n, a = [], xxhash.xxh3_64_intdigest, s.buckets, s.affix
    for word in words:
        w = word.lower().strip(_EDGES) or word
        out += (digest(w, 0) % n, digest("<" + w[:a], 1) % n, digest(w[-a:] + ">", 2) % n)
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _responses(projected: list[np.ndarray], starts: np.ndarray, width: int, bias: np.ndarray) -> np.ndarray:
    """Filter responses at every word; words beyond a text's end count as zero vectors."""
    n = len(projected[0])
    total = projected[0] + bias
    for k in range(1, width):
        moved = np.zeros_like(total)
        moved[: n - k] = projected[k][k:]
        for back in range(k):  # the last k words of each text have no successor at distance k
            at = starts[1:] - 1 - back
            moved[at[at >= starts[:-1]]] = 0
        total += moved
    return total


def _pooled(response: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts) - 1, response.shape[1]), dtype=np.float32)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(response, starts[:-1][full], axis=0)
    return np.maximum(out, 0)


def raw_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores before calibration."""
    words = split_words(texts)
    buckets = word_buckets(words.vocab.to_pylist(), model.settings)
    vectors = model.embed[buckets].sum(axis=1) if len(buckets) else np.zeros((0, model.settings.dim), np.float32)
    logits = np.full(len(words.counts), model.bias, dtype=np.float64)
    f = model.settings.filters
    ranges = _text_ranges(words.starts)
    for j, width in enumerate(model.settings.widths):
        projected = [vectors @ model.conv[j][k] for k in range(width)]
        for a, z in ranges:
            starts, codes = words.starts[a : z + 1] - words.starts[a], words.codes[words.starts[a] : words.starts[z]]
            response = _responses([x[codes] for x in projected], starts, width, model.conv_bias[j])
            logits[a:z] += _pooled(response, starts) @ model.out[j * f : (j + 1) * f]
    return logits


#: Bytes of texts that share a table of words, and words whose responses are held at once; a text is never cut.
_SLICE, _HELD = 4 << 20, 1 << 17


def _text_ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``_HELD`` words (one text at least)."""
    out, a = [], 0
    while a < len(starts) - 1:
        z = max(a + 1, int(np.searchsorted(starts, starts[a] + _HELD, side="right")) - 1)
        out.append((a, z))
        a = z
    return out


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * raw_scores(model, texts) + model.shift, -30, 30)))


def gradients(params: dict[str, np.ndarray], s: Settings, by_word: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean log loss of ``texts`` (word codes each): those of all parameters but the embeddings, then the embeddings' rows (repeated) and what each adds to."""
    f = s.filters
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    here = np.concatenate(texts) if len(texts) else np.empty(0, np.int32)
    x = params["embed"][by_word[here]].sum(axis=1) if len(here) else np.zeros((0, s.dim), np.float32)
    pooled, tops = [], []
    for j, width in enumerate(s.widths):
        response = _responses([x @ params[f"conv{j}"][k] for k in range(width)], starts, width, params[f"cb{j}"])
        pooled.append(_pooled(response, starts))
        tops.append(np.array([starts[d] + response[starts[d] : starts[d + 1]].argmax(axis=0) if counts[d] else np.zeros(f, int) for d in range(len(texts))]))
    hidden = np.concatenate(pooled, axis=1)
    p = 1 / (1 + np.exp(-np.clip(hidden @ params["out"] + params["bias"][0], -30, 30)))
    error = ((p - labels) / len(texts)).astype(params["out"].dtype)
    to_hidden = error[:, None] * params["out"] * (hidden > 0)
    at_rows, at_grads = [], []
    grads = {"out": hidden.T @ error, "bias": np.array([error.sum()], params["out"].dtype)}
    for j, width in enumerate(s.widths):
        g = to_hidden[:, j * f : (j + 1) * f]
        conv_grad = np.zeros_like(params[f"conv{j}"])
        d_, f_ = np.nonzero(g)
        for k in range(width):
            at = tops[j][d_, f_] + k
            ok = at < starts[d_ + 1]
            at, ff, gg = at[ok], f_[ok], g[d_[ok], f_[ok]][:, None]
            np.add.at(conv_grad[k].T, ff, x[at] * gg)
            at_rows.append(by_word[here[at]].reshape(-1))
            at_grads.append(np.repeat(params[f"conv{j}"][k][:, ff].T * gg, 3, axis=0))
        grads[f"conv{j}"] = conv_grad
        grads[f"cb{j}"] = g.sum(axis=0)
    return grads, np.concatenate(at_rows), np.concatenate(at_grads)


def _start(s: Settings) -> dict[str, np.ndarray]:
    """Parameters before the first epoch and, under names that begin with ``2``, sums of their squared gradients."""
    rng = np.random.default_rng(s.seed)
    k_out = s.filters * len(s.widths)
    params = {"embed": np.zeros((s.buckets, s.dim), np.float32), "out": rng.normal(0, 0.3, k_out).astype(np.float32), "bias": np.full(1, -1.0, np.float32)}
    for j, width in enumerate(s.widths):
        params[f"conv{j}"] = rng.normal(0, 0.3, (width, s.dim, s.filters)).astype(np.float32)
        params[f"cb{j}"] = np.full(s.filters, 0.05, np.float32)
    return params | {f"2{k}": np.full_like(v, 1e-3) for k, v in params.items()}


def _texts_of(codes: np.ndarray, starts: np.ndarray, by_word: np.ndarray, s: Settings) -> np.ndarray:
    """Texts that hold each bucket."""
    out = np.zeros(s.buckets, dtype=np.int64)
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        out[np.unique(by_word[codes[a:z]])] += 1
    return out


#: A shard's columns: where its texts start, their words' codes, the words' embedding rows, its texts by embedding row, labels.
_SHARD = {"starts": np.int64, "codes": np.int32, "by_word": np.int32, "texts_of": np.int64, "labels": np.float32}


def _packed(batches: Iterable[pa.RecordBatch], s: Settings) -> dict[str, np.ndarray]:
    """What the epochs read of a shard's rows (text, toxic), of which there is one at least."""
    parts, labels, n_words, n_codes = [], [], 0, 0
    for batch in batches:
        labels.append(batch.column("toxic").to_numpy())
        for part in slices(batch, "text", _SLICE):
            words = split_words(part.column("text"))
            by_word = word_buckets(words.vocab.to_pylist(), s).astype(np.int32)
            parts.append((words.starts[1:] + n_words, (words.codes + n_codes).astype(np.int32), by_word, _texts_of(words.codes, words.starts, by_word, s)))
            n_words, n_codes = n_words + len(words.codes), n_codes + len(by_word)
    starts, codes, by_word, texts_of = zip(*parts, strict=True)
    arrays = {"starts": np.concatenate(([0], *starts)), "codes": np.concatenate(codes), "by_word": np.concatenate(by_word), "texts_of": np.sum(texts_of, axis=0), "labels": np.concatenate(labels)}
    return {k: arrays[k].astype(kind, copy=False) for k, kind in _SHARD.items()}


def _epoch(state: dict[str, np.ndarray], live: np.ndarray, packed: dict[str, np.ndarray], s: Settings, epoch: int, shard: int) -> dict[str, np.ndarray]:
    """The state after one pass over a shard's texts."""
    state = {k: v.copy() for k, v in state.items()}
    starts, codes, by_word, labels = packed["starts"], packed["codes"], packed["by_word"].reshape(-1, 3), packed["labels"]
    live = live.astype(np.float32)[:, None]

    def step(name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        state[f"2{name}"][at] += grad**2
        state[name][at] -= s.rate * grad / np.sqrt(state[f"2{name}"][at])

    order = np.random.default_rng([s.seed, epoch, shard]).permutation(len(labels))
    for a in range(0, len(order), s.batch):
        docs = order[a : a + s.batch]
        here = [codes[starts[d] : starts[d + 1]] for d in docs]
        grads, at_rows, at_grads = gradients(state, s, by_word, here, labels[docs])
        for name in grads:
            grads[name] = grads[name] + (1e-5 * state[name] if name == "out" or name.startswith("conv") else 0)
        for name, grad in grads.items():
            step(name, grad)
        rows, inverse = np.unique(at_rows, return_inverse=True)
        total = np.zeros((len(rows), s.dim), np.float32)
        np.add.at(total, inverse, at_grads)
        step("embed", total * live[rows], rows)
    return state


#: Sums over shards are in whole numbers of this size, so that they are the same in any order.
_UNIT = 2.0**-24


def _weighted(state: dict[str, np.ndarray], texts_of: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Terms of the average of states: an embedding weighs by the texts that hold it (a trace where none does), all else by the rows."""
    by_bucket = (texts_of + 1e-3).astype(np.float64)
    terms = {k: v * (by_bucket[:, None] if k in ("embed", "2embed") else float(n)) for k, v in state.items()}
    return {k: np.rint(v / _UNIT).astype(np.int64) for k, v in (terms | {"by_bucket": by_bucket, "rows": np.array([float(n)])}).items()}


def _averaged(terms: dict[str, np.ndarray], like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The state, of the shapes of ``like``, from the sums of terms."""
    return {k: (terms[k].reshape(v.shape) / (terms["by_bucket"][:, None] if k in ("embed", "2embed") else terms["rows"])).astype(np.float32) for k, v in like.items()}


def _calibrate(model: Model, raw: np.ndarray, labels: np.ndarray, n: np.ndarray) -> None:
    """Platt scaling by Newton steps of bounded length, with a little weight on the uncalibrated score; ``n`` rows each."""
    scale, shift = 1.0, 0.0
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(scale * raw + shift, -30, 30)))
        grad = x.T @ (n * (p - labels)) + np.array([scale - 1.0, shift])
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2)
        scale, shift = np.array([scale, shift]) - np.clip(np.linalg.solve(hess, grad), -0.25, 0.25)
    if scale > 0:
        model.scale, model.shift = float(scale), float(shift)


def _best_threshold(p: np.ndarray, labels: np.ndarray, n: np.ndarray, default: float) -> float:
    best, at = -1.0, default
    for t in sorted({default, *np.round(np.linspace(0.05, 0.95, 19), 2).tolist()}, key=lambda v: abs(v - default)):
        hit = n[(p >= t) & (labels == 1)].sum()
        f1 = 2 * hit / max(1, n[p >= t].sum() + n[labels == 1].sum())
        if f1 > best + 1e-9:
            best, at = f1, t
    return float(at)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fits to all rows of ``labels`` (doc_id, toxic) whose ``held_out`` is false; four fifths train, one fifth calibrates and sets thresholds.

    Rows with a null label or doc_id teach nothing; a null text counts as empty.  A doc_id labelled
    twice counts once, as toxic if any of its rows says so.  Without labels every score is 0.5.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    if s.max_labelled is not None:
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    # one kind of join at every size: its shuffle grows with the input, and rows that are held out stay out of it
    data = docs.select("doc_id", "text", lang).filter(~held_out(F.col("doc_id"))).join(rows.hint("merge"), "doc_id").select("doc_id", "text", "lang", F.col("toxic").cast("int").alias("toxic"))
    if s.max_bytes is not None:
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
        data = data.withColumn("ahead", size).filter(F.col("ahead") <= s.max_bytes).drop("ahead")
    judge = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0
    data = scratch.save(data.withColumn("judge", judge), "labelled")
    toxic = F.col("toxic") == 1
    all_rows = data.agg(F.count("*").alias("n"), F.count_if(toxic & F.col("judge")).alias("judged"), F.count_if(toxic & ~F.col("judge")).alias("taught")).first()
    if not all_rows["n"]:
        f = s.filters
        return Model(s, np.zeros((s.buckets, s.dim), np.float32), [np.zeros((w, s.dim, f), np.float32) for w in s.widths], [np.zeros(f, np.float32) for _ in s.widths], np.zeros(f * len(s.widths), np.float32), 0.0)
    apart = min(all_rows["judged"], all_rows["taught"]) >= 5
    state = _fitted(scratch, data.filter("not judge") if apart else data, s)
    k = range(len(s.widths))
    model = Model(s, state["embed"], [state[f"conv{j}"] for j in k], [state[f"cb{j}"] for j in k], state["out"], float(state["bias"][0]))
    _judge(model, data.filter("judge") if apart else data)
    scratch.drop("labelled")
    return model


def _fitted(scratch: Scratch, data: DataFrame, s: Settings) -> dict[str, np.ndarray]:
    """The state after all epochs over ``data`` (doc_id, text, toxic)."""
    spark = data.sparkSession
    size = data.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).first()
    shards = max(1, -(-size["n"] // s.shard_rows), -(-size["bytes"] // s.shard_bytes))
    dealt = data.select(F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(shards)).alias("shard"), "doc_id", "text", "toxic")
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            yield from ((int(ids[a]), batch.slice(a, z - a)) for a, z in pairwise(cuts) if z > a)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each run of equal shards; their texts stream past and stay as numbers alone."""
        for shard, run in groupby(pieces(batches), itemgetter(0)):
            for batch in _cut(_packed((x for _, x in run), s)):
                yield batch.append_column("shard", pa.array([shard] * batch.num_rows, pa.int64()))

    # the rows of a shard stay in one row group, which one task reads: some shards at most share a partition and so a file
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "doc_id").drop("doc_id")
    packed = scratch.save(dealt.mapInArrow(pack, f"{_ROWS}, shard long"), "shards", options={"parquet.block.size": 1 << 30})

    def terms_of(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((x.column("shard")[0].as_py(), x) for batch in batches for x in map(partial(batch.slice, length=1), range(batch.num_rows)))
            for shard, mine in groupby(rows, itemgetter(0)):
                arrays = _joined(x for _, x in mine)
                yield from _cut(work(shard, {k: arrays[k].view(kind) for k, kind in _SHARD.items()}))

        return run

    def gathered(work, name: str) -> dict[str, np.ndarray]:
        """The sum over shards of what ``work`` makes of each, a few at a time and without a shuffle."""
        names, left = [name], shards
        out = scratch.save(packed.mapInArrow(terms_of(work), _ROWS), name, conf=_FEW_ROWS)
        while left > 1:
            left = -(-left // s.merged)
            names.append(f"{name}-{len(names)}")
            out = scratch.save(out.coalesce(left).mapInArrow(_summed, _ROWS), names[-1], conf=_FEW_ROWS)
        total = _joined([pa.RecordBatch.from_pylist([r.asDict()]) for r in out.collect()])
        scratch.drop(*names)
        return {k: v.view(np.int64) for k, v in total.items()}

    def taught(shared, epoch: int):
        def work(shard: int, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            return _weighted(_epoch(*shared.value, arrays, s, epoch, shard), arrays["texts_of"], len(arrays["labels"]))

        return work

    live = gathered(lambda shard, arrays: {"texts": arrays["texts_of"]}, "counted")["texts"] >= s.least_texts
    state = like = _start(s)
    for epoch in range(s.epochs):
        shared = spark.sparkContext.broadcast((state, live))
        state = _averaged(gathered(taught(shared, epoch), f"epoch-{epoch}"), like)
        shared.destroy()
    scratch.drop("shards")
    return state


#: Arrays travel in rows of this many bytes before compression, a few in a batch: rows of tens of MB made the executors' heaps grow to their limit.
_ROW = 1 << 18
_ROWS = "name string, at long, part binary"
_FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}


def _cut(arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The arrays' bytes in rows (name, at, part)."""
    rows = ((k, at, v) for k, x in arrays.items() for v in (np.ascontiguousarray(x).reshape(-1).view(np.uint8),) for at in range(0, max(1, len(v)), _ROW))
    while few := list(islice(rows, 8)):
        parts = [zlib.compress(v[at : at + _ROW], 1) for _, at, v in few]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in few]), pa.array([at for _, at, _ in few], pa.int64()), pa.array(parts, pa.binary())], ["name", "at", "part"])


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    for batch in batches:
        for name, at, part in zip(*(batch.column(c) for c in ("name", "at", "part")), strict=True):
            yield (name.as_py(), at.as_py()), np.frombuffer(zlib.decompress(part.as_buffer()), np.uint8)


def _joined(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The arrays of ``_cut``, flat and as bytes."""
    by_name: dict[str, list[tuple[int, np.ndarray]]] = {}
    for (name, at), part in _parts(batches):
        by_name.setdefault(name, []).append((at, part))
    return {k: np.concatenate([part for _, part in sorted(v, key=itemgetter(0))]) for k, v in by_name.items()}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sum of all rows' whole numbers, place by place; none without rows."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for key, part in _parts(batches):
        total[key] = total[key] + part.view(np.int64) if key in total else part.view(np.int64)
    for (name, at), v in total.items():
        for batch in _cut({name: v}):
            yield batch.set_column(1, "at", pa.array([at], pa.int64()))


#: Raw scores of the judged rows count in bins of this width, with the mean of each.
_BIN = 1e-3


def _judge(model: Model, data: DataFrame) -> None:
    """Calibrates and chooses thresholds on all rows of ``data``, counted by bin of raw score, label and language: a table as long as there are bins."""
    shared = data.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(raw_scores(shared.value, part.column("text"))), part.column("toxic"), part.column("lang")], ["raw", "toxic", "lang"])

    raw = data.select("text", "toxic", "lang").mapInArrow(run, "raw double, toxic int, lang string")
    bins = raw.groupBy(F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), "raw")) / _BIN).cast("long").alias("bin"), "toxic", "lang").agg(F.avg("raw").alias("raw"), F.count("*").alias("n"))
    rows = sorted(bins.collect(), key=lambda r: (r["bin"], r["toxic"], r["lang"] or ""))
    x, y, n = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("raw", "toxic", "n"))
    _calibrate(model, x, y, n)
    p = 1 / (1 + np.exp(-np.clip(model.scale * x + model.shift, -30, 30)))
    langs = [r["lang"] for r in rows]
    for lang in sorted({v for v in langs if v is not None}):
        mine = np.array([v == lang for v in langs])
        if (n * y)[mine].sum() >= 20:
            model.thresholds[lang] = _best_threshold(p[mine], y[mine], n[mine], model.settings.threshold)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with its columns alone, whatever their names."""
    prefix = "_" * (1 + max(map(len, docs.columns)))
    return score(docs, model, prefix).filter(f"not {prefix}rejected").select(*docs.columns)


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` (doc_id, text, perhaps lang and more columns) with ``score``, ``threshold`` and ``rejected``.

    ``rejected``: the score reaches ``threshold``, that of the row's language, or the common one for a
    language without one.  Texts are read whole; null counts as empty.  Every row is returned once,
    repeated rows included; columns of these names, which ``prefix`` begins, are replaced.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(*(f"{prefix}{c}" for c in ("score", "threshold", "rejected")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(shared.value, part.column("text")))], [*names, f"{prefix}score"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{prefix}score", T.DoubleType())]))
    limit = F.lit(float(model.settings.threshold))
    if "lang" in names:
        for lang, value in sorted(model.thresholds.items()):
            limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return out.withColumn(f"{prefix}threshold", limit).withColumn(f"{prefix}rejected", F.col(f"{prefix}score") >= F.col(f"{prefix}threshold"))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Fits and scores: every column of ``docs``, held_out, score, predicted (score >= the common threshold), threshold and rejected by language."""
    out = score(docs, fit(docs, labels, s))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
