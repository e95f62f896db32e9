"""The training-data operators against brute force, on small tables with awkward rows."""
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bloom_lm, quality_rules, token_store
from loomgraph.llm.components import components
from loomgraph.llm.decontamination import decontaminate, find_windows, benchmark_windows
from loomgraph.llm.jaccard_join import jaccard_components
from loomgraph.llm.language_id import held_out, identify
from loomgraph.llm.license_rules import scan_licenses
from loomgraph.llm.piece_codec import decode, digests, encode
from loomgraph.llm.suffix_dedup import mark_repeats

# names that clash with inner columns
SCHEMA = "doc_id long, text string, lang string, key string, n int, row int"
LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"p{i}" for i in rng.integers(0, 400, n))


TEXTS = [None, "", " \n\t ", "One", "é" * 3000, LONG, LONG, "?! 123", "a b", "a b", passage(1, 60),
         passage(1, 60) + " tail", "head " + passage(1, 60), passage(2, 13), "x " * 70 + passage(2, 13),
         passage(3, 200), " ".join(passage(3, 200).split()[:190]), *["hot copy of a short text"] * 60]
ROWS = [(i if i != 3 else None, t, "en" if i % 2 else None, "k", 1, 1) for i, t in enumerate(TEXTS)]
ROWS += [(9, "a b", "de", "k", 2, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def blank_words(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", fold(text)) if w]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_jaccard_join(spark, docs, empty):
    sets = []
    for _, text, *_ in ROWS:
        w = blank_words(text)
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                up[max(top(i), top(j))] = min(top(i), top(j))
    names = {}
    for i, row in enumerate(ROWS):
        if row[0] is not None:
            names[top(i)] = min(row[0], names.get(top(i), row[0]))
    want = [(r[0], len(sets[i]), names.get(top(i))) for i, r in enumerate(ROWS)]
    same([tuple(r) for r in jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()], want)
    assert jaccard_components(empty).count() == 0


def test_jaccard_needs_the_second_pass(spark):
    """Random sets that share pieces: neighbours in a column are often not the similar ones."""
    rng = np.random.default_rng(5)
    base = [passage(100 + i, 40).split() for i in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, 40)] = f"z{rng.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    up = list(range(150))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(150):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                up[max(top(i), top(j))] = min(top(i), top(j))
    got = {r.doc_id: r.component_id for r in jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in range(150)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_decontamination(spark, docs, empty):
    items = [(10, passage(2, 13)), (2, passage(1, 60)), (3, "A B"), (4, None), (5, ""), (None, "a b"), (2, "hot copy")]

    def words(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text)) if w]

    want = []
    for doc_id, text, *_ in ROWS:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for s in range(max(1, len(q) - 12)) if q and item is not None else ():
                part = q[s:s + 13]
                for a in range(len(w) - len(part) + 1):
                    if w[a:a + len(part)] == part:
                        hit.update(range(a, a + len(part)))
                        ids.add(str(item))
        want.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                     bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs.drop("row"), bench)
    same([tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], want)
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one two extra three four"), (3, "four three")],
                                 "doc_id long, text string")
    windows = benchmark_windows(spark.createDataFrame([(1, "one two three four")], "item_id long, text string"), 13)
    assert [r.kind for r in find_windows(docs, windows, 13).collect()] == ["phrase"]
    kinds = Counter(r.kind for r in find_windows(docs, windows, 13, slop=1).collect())
    assert kinds["phrase"] == 1 and kinds["proximity"] >= 1


def test_language(spark, docs, empty):
    train = spark.createDataFrame([("der die und das", "de"), ("the and of that", "en"), (None, "xx"), ("12", "yy"),
                                   ("abc", None)], "text string, lang string")
    rows = spark.createDataFrame([(1, "und die"), (2, "and that"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, train).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert identify(docs, docs).count() == len(ROWS) and identify(empty, empty).count() == 0
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        identify(rows, train, max_langs=1)


def test_piece_codec(spark, docs, empty):
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    extra = ["  two  blanks ", "a\n\n\tb", "日本語 ▁▁x▁ <s></s><0x0A>", "aaaaaaaaaaaaaaaaaaaaaaa" * 90]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = []
    for doc_id, text in [r[:2] for r in ROWS] + list(enumerate(extra)):
        ids = sp.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    same([tuple(r) for r in digests(rows, model).collect()], want)
    back = decode(encode(rows, model), model).collect()
    assert all(r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids) for r in back)
    assert digests(empty, model).count() == 0


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    coded = sorted((r[0] is not None, r[0] or 0, tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in ROWS)
    want, at = [], 0
    for known, doc_id, ids in coded:
        want.append((doc_id if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same([tuple(r) for r in token_store.ids_crc32(token_store.round_trip(docs, path, 2)).collect()], want)
    assert token_store.round_trip(empty, path, 2).count() == 0


def test_damaged_chunk_is_noticed():
    ids = np.arange(1000) % 7
    table = token_store.Frequencies(np.bincount(ids))
    data = bytearray(token_store.encode_chunk(ids, table))
    assert (token_store.decode_chunk(bytes(data), 1000, table) == ids).all()
    data[3] ^= 1
    try:
        assert not (token_store.decode_chunk(bytes(data), 1000, table) == ids).all()
    except ValueError:
        pass


def test_suffix_dedup(docs, empty):
    counts, want = Counter(), []
    words = [blank_words(r[1]) for r in ROWS]
    for w in words:
        counts.update(tuple(w[j:j + 50]) for j in range(len(w) - 49))
    for row, w in zip(ROWS, words):
        covered = set()
        for j in range(len(w) - 49):
            if counts[tuple(w[j:j + 50])] > 1:
                covered.update(range(j, j + 50))
        want.append((row[0], len(covered)))
    same([tuple(r) for r in mark_repeats(docs).select("doc_id", "n_repeated").collect()], want)
    assert mark_repeats(empty).count() == 0


def test_suffix_dedup_among_many_partners(spark):
    # parts of one passage: a piece has many holders, most of which share under 50 words
    rng, base, rows = np.random.default_rng(5), [f"b{i}" for i in range(64)], []
    for i in range(400):
        low, high = sorted(rng.choice(65, 2, replace=False))
        around = [f"r{i}x{j}" for j in range(60)]
        rows.append((i, " ".join(around[:30] + base[low:high] + around[30:])))
    counts, want = Counter(), []
    for _, text in rows:
        w = text.split()
        counts.update(tuple(w[j:j + 50]) for j in range(len(w) - 49))
    for i, text in rows:
        w = text.split()
        covered = {k for j in range(len(w) - 49) if counts[tuple(w[j:j + 50])] > 1 for k in range(j, j + 50)}
        want.append((i, len(covered)))
    got = mark_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    same([tuple(r) for r in got.select("doc_id", "n_repeated").collect()], want)


def test_bloom_lm(docs, empty):
    counts = Counter(w for r in ROWS for w in [*blank_words(r[1]), "</s>"])
    total, distinct = sum(counts.values()), len(counts)
    got = bloom_lm.score(docs, docs).collect()
    assert len(got) == len(ROWS)
    want = sorted((r[0] is None, r[0] or 0, len(blank_words(r[1])) + 1, round(sum(
        math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*blank_words(r[1]), "</s>"]), 4)) for r in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.n_tokens == r.n_known and r.train_tokens == total and r.score < 0 for r in got)
    assert bloom_lm.score(empty, docs).count() == 0
    assert {r.n_known for r in bloom_lm.score(docs, empty).collect()} == {0}


def test_bloom_lm_holds_all_and_in_parts(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a c d " + " ".join(f"w{i}" for i in range(3000))), (3, None)], "doc_id long, text string")
    whole, cut = ({r.doc_id: r for r in bloom_lm.score(texts, texts, **some).collect()} for some in ({}, {"max_bytes": 4000}))
    total, distinct = 3008, 3005  # a twice, an end thrice (which counts as 2.5, the middle of its level)
    p = [(c + 0.5) / (total + 0.5 * (distinct + 1)) for c in (2.5, 1, 2.5)]
    # "a b" and "b <end>" are seen once
    want = math.log10(p[0]) + math.log10(0.7 * p[1] + 0.3 / 2.5) + math.log10(0.7 * p[2] + 0.3)
    assert abs(whole[1].score - want) < 1e-6, (whole[1].score, want)
    assert all(abs(whole[i].score - cut[i].score) < 0.02 * abs(whole[i].score) for i in (1, 2, 3))


def test_quality_rules(spark, docs, empty):
    rows = [(i, ("calm words here " if i % 2 else "LOUD!! WORDS!! ") * (5 + i % 7)) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(1, None)], "doc_id long, quality int")
    model = quality_rules.train(texts, labels)
    assert all((r.score >= 0.5) == bool(r.predicted) == bool(r.doc_id % 2) for r in quality_rules.score(texts, model).collect())
    scored = quality_rules.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert quality_rules.score(empty, quality_rules.train(empty, labels)).count() == 0


def test_licences(spark, docs, empty):
    rows = [(1, "Text. Licensed under the  Apache License, Version 2.0.\nYou may not use this file except in compliance with the License."),
            (2, "Released under the MIT License. All rights reserved."), (3, "No licence."), (4, None), (4, None)]
    got = sorted(map(tuple, scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, "Apache-2.0", "Apache-2.0"), (2, 2, "MIT,proprietary", "MIT"), (3, 0, "", None),
                          (4, 0, "", None), (4, 0, "", None)], key=repr)
    assert scan_licenses(docs).count() == len(ROWS) and scan_licenses(empty).count() == 0


def test_licences_of_repeated_rows(spark):
    rows = [(1, "Released under the MIT License.")] * 2 + [(2, "Licensed under the Apache License, Version 2.0.")] * 2
    got = sorted(map(tuple, scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, "MIT", "MIT")] * 2 + [(2, 1, "Apache-2.0", "Apache-2.0")] * 2


HEADERS = {
    "Apache-2.0": """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software""",
    "BSD-3-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:
 *
 *     * Redistributions of source code must retain the above copyright
 * notice, this list of conditions and the following disclaimer.
 *     * Redistributions in binary form must reproduce the above
 * copyright notice, this list of conditions and the following disclaimer
 * in the documentation and/or other materials provided with the
 * distribution.
 *     * Neither the name of Some Company Inc. nor the names of its
 * contributors may be used to endorse or promote products derived from
 * this software without specific prior written permission.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the \u201cSoftware\u201d), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "GPL-2.0": """// it under the terms of the GNU General Public License version 2
// This program is free software; you can redistribute it and/or modify it
// under the terms of the GNU General Public License as published by the
// Free Software Foundation; version 2 of the License.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "EPL-2.0": """ * This program and the accompanying materials are made
 * available under the terms of the Eclipse Public License 2.0
 * which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free",
    "GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "CC-BY-4.0": "The data are licensed under a Creative Commons Attribution 4.0 International License.",
}


def test_licence_headers(spark):
    rows = [(name, text) for name, text in HEADERS.items()] + [
        ("MIT", "A line\nThis file is licensed under the MIT license.\r\nMore"), (None, "It is not licensed under the MIT license."),
        (None, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (None, "Licensed under\n \t\nthe MIT license."), ("GPL-3.0-or-later", "Released under GPLv3+.")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.license or "") for r in got) == sorted((n or "", n or "") for n, _ in rows)


def test_pipeline_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, passage(2, 13))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    # by hand: no letters go; the largest of equal texts, the smallest of near copies, no benchmark text
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted(
        [(True, 0), *((False, i) for i in (4, 6, 9, 10, 15, 76))])
    assert set(out.columns) == {*docs.columns, "ids", "n_tokens", "decoded_sha256"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_texts_are_tokenized_in_slices_of_bytes(spark, monkeypatch):
    """64 texts at a time were megabytes of tokens, whatever their length, on as many threads as there are cores."""
    from tokenizers import Tokenizer

    from loomgraph.llm import token_store
    texts = [None, "", *(f"word {i} " * 9000 for i in range(40)), "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: list(r.ids) for r in token_store.tokenize(rows, path, 2).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}

    sizes = []

    class Watched:
        def encode_batch_fast(self, part, **how):
            sizes.append((len(part), sum(map(len, part)), os.environ["TOKENIZERS_PARALLELISM"]))
            return tokenizer.encode_batch_fast(part, **how)

    run = []
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    monkeypatch.setattr(token_store, "worker_state", lambda key, make: Watched())
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, fn, kind: run.append(fn))
    token_store.tokenize(rows, path, 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert sum(len(part) for part in run[0](iter([batch]))) == len(texts)
    assert all(chars <= token_store.SLICE and threads == "false" for _, chars, threads in sizes) and len(sizes) > 10


def test_words_go_through_the_tokenizer_once(spark, monkeypatch):
    """Every word of every text went through it, which took most of the time of op7."""
    import random

    from tokenizers import Tokenizer

    from loomgraph.llm import token_store
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, coded = Tokenizer.from_file(path), []
    assert token_store.blanks_only_part(path)

    class Watched:
        def encode_batch_fast(self, part, **how):
            coded.extend(part)
            return tokenizer.encode_batch_fast(part, **how)

    def ids(texts):
        got, ends = words.code([t.encode() for t in texts])
        return [x.tolist() for x in np.split(got, ends[:-1])]

    words = token_store.WordIds(Watched(), 2)
    texts = ["some word's again, some word's again", "", "again, new"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids(texts), ids(texts)] == [want, want]
    assert " ".join(coded).split().count("again,") == 1
    # blanks, other separators, marks, letters that are put together or lower-cased to several, special tokens
    odd = [*" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0  　́̈ᅡᄀͅaeEsΣσ'1½.,<|>-é﻿‍😀İßﬁ\x00\x01",
           "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "\x01a"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(odd, k=draw.randrange(25))) for _ in range(3000)]
    monkeypatch.setattr(token_store, "KEPT", 2000)
    for i in range(0, len(texts), 100):
        part = texts[i:i + 100]
        assert ids(part) == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in part]


def test_vocabularies_with_blanks_in_their_tokens(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from loomgraph.llm import token_store
    tokenizer = Tokenizer(models.BPE({"a": 0, "Ġ": 1, "Ġa": 2, "b": 3, "x": 4}, [("Ġ", "a")]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.save(path := str(tmp_path / "blanks.json"))
    assert not token_store.blanks_only_part(path)
    rows = spark.createDataFrame([(1, "a a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in token_store.tokenize(rows, path, 4).collect()} == {1: [0, 2, 1, 3, 4], 2: [4]}


def test_a_filter_slice_is_shuffled_as_lists_of_bits(spark, monkeypatch):
    """Each of a filter's words was a row of its own in the shuffle."""
    monkeypatch.setattr(bloom_lm, "GATHERED", 1000)
    monkeypatch.setattr(bloom_lm, "SLICE", 4)
    monkeypatch.setattr(bloom_lm, "SLICES", 5)
    monkeypatch.setattr(bloom_lm, "WORDS", 500)
    counts = spark.range(6000).select(F.xxhash64("id").alias("gram"), (1 + F.col("id") % 5).alias("n")).coalesce(1)
    table = bloom_lm.build_filter(counts)
    rows = counts.collect()
    size = -(-sum(r.n.bit_length() for r in rows) * bloom_lm.BITS_PER_ENTRY // 64)
    want = [0] * size
    for level in (1, 2, 3):
        grams = np.array([r.gram for r in rows if r.n.bit_length() >= level], np.int64).view(np.uint64)
        for bit in np.concatenate(bloom_lm._bits(grams, level, size * 64)).tolist():
            want[bit >> 6] |= 1 << (bit & 63)
    assert table.tolist() == want

    widest, made = [], type(counts).mapInArrow
    monkeypatch.setattr(type(counts), "mapInArrow", lambda self, fn, kind: widest.append(made(self, fn, kind)) or widest[-1])
    bloom_lm.build_filter(counts)
    assert widest[0].count() <= 6 * 5  # lists of so many n-grams, each in so many slices


def test_frequent_words_are_not_shuffled_for_the_base_score(spark, docs, monkeypatch):
    """Every word of every text was stored, and shuffled to meet its count."""
    want = {r.row: r for r in bloom_lm.score(docs, docs).collect()}
    kept, write = {}, bloom_lm.materialize
    monkeypatch.setattr(bloom_lm, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    for often, rest in ((0, True), (3, True), (1 << 17, False)):
        monkeypatch.setattr(bloom_lm, "FREQUENT", often)
        kept.clear()
        got = bloom_lm.score(docs, docs).collect()
        assert bool(kept["scored"].agg(F.sum(F.size("tokens"))).first()[0]) == rest
        assert all((r.n_known, r.n_tokens) == (want[r.row].n_known, want[r.row].n_tokens)
                   and abs(r.base_score - want[r.row].base_score) < 1e-9 * abs(r.base_score) for r in got)


def test_pairs_meet_their_sets_in_rounds_without_shuffling_the_sets(spark, monkeypatch):
    """Both sets of every pair were shuffled, all pairs at once."""
    from loomgraph.llm import jaccard_join as jj
    rows = [(i, " ".join(f"w{j}" for j in range(40) if j not in (i, i + 20))) for i in range(8)]
    texts = spark.createDataFrame([*rows, (8, rows[0][1]), (9, "other words in one text of its own"), (None, rows[1][1]), (10, "")],
                                  "doc_id long, text string")
    members = jj.materialize(jj.shingle_sets(texts, 1, whole=False), "members")
    ids = [r[0] for r in members.where("class_id is not null").select("class_id").distinct().orderBy("class_id").collect()]
    pairs = jj.materialize(spark.createDataFrame([(x, y) for x in ids for y in ids if x < y], "a binary, b binary"), "pairs")
    plans, write = [], jj.materialize
    monkeypatch.setattr(jj, "materialize", lambda df, label: (
        plans.append(df._jdf.queryExecution().toString()) if label == "links" else None, write(df, label))[1])
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(bytes(r.a), bytes(r.b)) for r in jj.verified(pairs, texts, members, 90, 1).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    sets = {bytes(r.class_id): set(r.shingles) for r in jj.shingle_sets(texts, 1).where("class_id is not null").collect()}
    want = {(x, y) for x in sets for y in sets if x < y
            and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y])}
    assert got == want and 0 < len(want) < pairs.count()
    assert len(plans) == 4  # 36 pairs of 9 sets
    assert all(p.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 2 for p in plans)


def test_shuffle_files_go_when_a_step_is_written(tmp_path):
    """They stayed until the driver collected its garbage, so all steps' files lay on the disk together."""
    import subprocess
    import sys
    from pathlib import Path
    code = f"""
import time
from pathlib import Path
from loomgraph.session import build_session, materialize
spark = build_session("files", "local[2]", **{{"spark.local.dir": {str(tmp_path / 'local')!r}, "spark.ui.enabled": "false",
                      "spark.checkpoint.dir": {str(tmp_path / 'kept')!r}, "spark.sql.shuffle.partitions": "2"}})
kept = materialize(spark.range(1000).repartition(3, "id"), "rows")
for _ in range(40):
    left = list(Path({str(tmp_path / 'local')!r}).rglob("shuffle_*.data"))
    if not left:
        break
    time.sleep(0.5)
print("files", len(left), kept.count())
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=200)
    assert "files 0 1000" in run.stdout, run.stdout + run.stderr[-2000:]


def test_marks_and_first_shared_shingles_lose_no_pair(spark, monkeypatch):
    """Sets that are half alike met once for each shingle they share, and were all compared whole."""
    from loomgraph.llm import jaccard_join as jj
    rng = np.random.default_rng(3)
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(60):  # similar to one another from far below to far above the limit, in 64 to 1,024 bits
        n = 30 if i % 3 else 300 if i % 2 else 250
        w = base[:n]
        for at in rng.choice(n, int(n * (i % 10) / 30), replace=False):
            w[at] = f"z{i}_{at}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(t.split()) for _, t in rows]
    links = {(i, j) for i in range(60) for j in range(60)
             if i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    members = jj.materialize(jj.shingle_sets(docs, 1, whole=False), "members")
    # rows of one class (equal sets) stand for each other
    ids = {bytes(r.class_id): r.doc_id for r in members.collect()}
    links = {(i, j) for i, j in links if {i, j} <= set(ids.values())}
    every = spark.createDataFrame([(a, b) for a in ids for b in ids if a != b], "a binary, b binary")
    left = {(ids[bytes(r.a)], ids[bytes(r.b)]) for r in jj.plausible(every, members, 75).collect()}
    assert links <= left and len(left) < len(ids) ** 2 / 4
    head = jj.materialize(jj.heads(docs, 75, 1).withColumn("component", F.col("class_id")), "heads")
    counts = Counter(frozenset((ids[bytes(r.a)], ids[bytes(r.b)])) for r in jj.meetings(head, 75).collect())
    assert {frozenset(x) for x in links} <= set(counts)
    assert sum(counts.values()) < 2 * len(counts)
    monkeypatch.setattr(jj, "BEFORE", 1)
    assert {frozenset(x) for x in links} <= {frozenset((ids[bytes(r.a)], ids[bytes(r.b)]))
                                             for r in jj.meetings(head, 75).collect()}


def test_frequent_words_stay_when_kept_words_are_too_many(monkeypatch):
    """All words went when they took 8 MB, which is some hundred MB with what belongs to them."""
    from tokenizers import Tokenizer
    tokenizer, coded = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []

    class Watched:
        def encode_batch_fast(self, texts, **kind):
            coded.extend(texts)
            return tokenizer.encode_batch_fast(texts, **kind)

    monkeypatch.setattr(token_store, "KEPT", 3000)
    words = token_store.WordIds(Watched(), 2)
    for i in range(60):
        texts = [f"often used words r{i}x{j} q{j}y{i}" for j in range(20)] + ["", "used twice used"]
        got, ends = words.code([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(got, ends[:-1])] == [
            tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert words.bytes < 3000 + 400 and len(words.places) == len(words.uses)
    assert " ".join(coded).split().count("often") == 1 and token_store.KEPT < 1 << 23


def test_batches_of_long_texts_are_small(spark):
    """10,000 rows were one batch, however long."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 6 << 20
