"""License texts by diagonal voting.

Every rolling k-word hash of every text is joined to the template positions that hold the same k
words.  A hit votes for the diagonal ``text position - template position``; diagonals of one text
and template that lie close together (a few words put in or left out) merge, and each merged span
is verified on its words by their longest common subsequence with the template.  Short fixed
phrases are found exactly beside that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.llm.scratch import Scratch
from hexflow.llm.text import Words, ngram_hashes, slices, split_words, within
from hexflow.session import ship_package

#: Fixed phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Public license notices and the openings of license texts.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
)


@dataclass(frozen=True)
class Settings:
    k: int = 4
    #: Diagonals at most so far apart merge.
    slack: int = 8
    #: Share of a template's words that a span must hold in order.
    share: float = 0.8


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and every other ASCII character but a-z and 0-9 as a space."""
    raw = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
    return pa.array([t.translate(_FOLD).decode() for t in raw], pa.string())


def license_words(texts: pa.Array) -> Words:
    return split_words(folded(texts))


def _template_words() -> list[tuple[str, list[str]]]:
    return [(label, folded(pa.array([text]))[0].as_py().split()) for label, text in TEMPLATES]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(p.split(), label) for p, label in PHRASES]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            words = license_words(part.column("text"))
            n = part.num_rows
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            owner = np.repeat(np.arange(n), words.counts)
            code = {w: k for k, w in enumerate(words.vocab.to_pylist())}
            for phrase, label in phrases:
                if not all(w in code for w in phrase):
                    continue
                ok = within(words.starts, len(phrase))
                for k, w in enumerate(phrase):
                    ok = ok & (words.codes[k : k + len(ok)] == code[w])
                at = np.flatnonzero(ok)
                doc, pos = owner[at], at - words.starts[owner[at]]
                np.add.at(count, doc, 1)
                np.minimum.at(first, doc, pos)
                np.maximum.at(last, doc, pos)
                for d in set(doc.tolist()):
                    labels[d].add(label)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(words.counts), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"],
            )


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = license_words(part.column("text"))
                g, at = ngram_hashes(words.hashes(), k), np.flatnonzero(within(words.starts, k))
                owner = np.repeat(np.arange(part.num_rows), words.counts)[at]
                ids, keys = (part.column(c).take(pa.array(owner)) for c in ("doc_id", "key"))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array((at - words.starts[owner]).astype(np.int32)), pa.array(g[at].view(np.int64))], ["doc_id", "key", "pos", "gram"])

    return run


def template_positions(spark, s: Settings) -> DataFrame:
    """(gram, template, at, template_words): a table as large as the templates above, whatever the corpus."""
    rows = []
    for t, (_, words) in enumerate(_template_words()):
        one = split_words(pa.array([" ".join(words)]))
        rows += [(int(h), t, at, len(words)) for at, h in enumerate(ngram_hashes(one.hashes(), s.k).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, at int, template_words int")


def common_subsequence(words: list[str], wanted: list[str]) -> list[int]:
    """Places in ``words`` of a longest common subsequence with ``wanted``, the earliest words of those that end last."""
    lengths = [[0] * (len(wanted) + 1)]
    for w in words:
        above, row = lengths[-1], [0]
        for j, v in enumerate(wanted):
            row.append(above[j] + 1 if w == v else max(above[j + 1], row[j]))
        lengths.append(row)
    out, i, j = [], len(words), len(wanted)
    while i and j:
        if words[i - 1] == wanted[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif lengths[i - 1][j] >= lengths[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _verified(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _template_words()
        for batch in batches:
            out: list[tuple] = []
            for doc, key, t, first, last, diagonal, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "template", "first", "last", "diagonal", "text")), strict=True):
                label, wanted = templates[t]
                words = folded(pa.array([text], pa.string()))[0].as_py().split()
                # From where the first diagonal lays the template's begin to where the last one lays its end.
                a, z = max(0, first - s.slack), min(len(words), max(last + s.k, diagonal + len(wanted)) + s.slack)
                same = common_subsequence(words[a:z], wanted)
                if same and len(same) >= s.share * len(wanted):
                    out.append((doc, key, label, len(same) / len(wanted), a + same[0], a + same[-1] + 1))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "key", "label", "share", "first_word", "end_word"])

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's spans (in a partition sorted by text and place) the best, and of those that don't overlap it the best, and so on.

    Only a chain of overlapping spans is held at a time.
    """
    names = ["doc_id", "key", "label", "share", "first_word", "end_word"]
    held: list[dict] = []

    def chosen() -> list[dict]:
        kept: list[dict] = []
        for r in sorted(held, key=lambda r: (-r["share"], r["first_word"] - r["end_word"], r["label"], r["first_word"])):
            if all(r["first_word"] >= k["end_word"] or r["end_word"] <= k["first_word"] for k in kept):
                kept.append(r)
        held.clear()
        return kept

    for batch in batches:
        out: list[dict] = []
        for r in batch.select(names).to_pylist():
            if held and ((held[0]["doc_id"], held[0]["key"]) != (r["doc_id"], r["key"]) or r["first_word"] >= max(k["end_word"] for k in held)):
                out += chosen()
            held.append(r)
        yield pa.RecordBatch.from_pylist(out, batch.schema)
        schema = batch.schema
    if held:
        yield pa.RecordBatch.from_pylist(chosen(), schema)


def spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, key, label, share, first_word, end_word): verified template spans of every distinct text.

    ``key`` hashes doc_id and text, so rows without a doc_id and rows that share one have spans of
    their own.  Templates of one family share most words: of spans that overlap, the one that holds
    most of its template stays, and all that are disjoint from those that stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    texts = docs.select("doc_id", _key().alias("key"), "text")
    hits = texts.mapInArrow(_grams(s.k), "doc_id long, key long, pos int, gram long").join(F.broadcast(template_positions(spark, s)), "gram")
    place = ["doc_id", "key", "template"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*place, "diagonal")
    votes = votes.agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = W.partitionBy(*place).orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > s.slack).cast("int")).withColumn("group", F.sum(F.coalesce("new", F.lit(0))).over(by))
    merged = votes.groupBy(*place, "group").agg(F.least(F.min("first"), F.min("diagonal")).alias("first"), F.max("last").alias("last"), F.max("diagonal").alias("diagonal"))
    likely = scratch.save(merged.select(*place, "first", "last", "diagonal"), "likely")
    asked = likely.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    whole = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "key"])
    whole = whole.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "text")
    found = likely.join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select(*place, "first", "last", "diagonal", "text")
    kinds = "doc_id long, key long, label string, share double, first_word long, end_word long"
    found = found.mapInArrow(_verified(s), kinds)
    return found.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "first_word", "end_word", "label").mapInArrow(_apart, kinds)


def _key():
    return F.xxhash64("doc_id", "text")


def scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII; a null text has none.
    ``n_base`` counts all places of the fixed phrases; ``labels`` adds those of verified template
    spans; ``score`` is 1 with a phrase, otherwise the best verified share, 0 without any.  Rows
    without a doc_id and rows that share one are scanned each.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    ship_package(docs.sparkSession)
    base = docs.select("doc_id", _key().alias("key"), "text").mapInArrow(_phrases, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    found = spans(docs, s).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
