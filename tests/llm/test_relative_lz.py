"""Removal of repeated passages against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.relative_lz import factors, remove_repeats

SCHEMA = "doc_id long, text string, key string, late int, spans int, run int"


def brute(rows, size=50):
    blank = lambda t: [w for w in re.split("[\x20\x09-\x0D]+", t or "") if w]
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        w = blank(t)
        for i in range(len(w) - size + 1):
            s = tuple(w[i:i + size])
            first[s] = min(first.get(s, order(d)), order(d))
    out = []
    for d, t in rows:
        w = blank(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < order(d):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passage(seed, n, of=400):
    return " ".join(f"P{i}" for i in np.random.default_rng(seed).integers(0, of, n))


def awkward():
    rng, rows = random.Random(4), []
    phrase = passage(1, 20)
    for i in range(90):  # one phrase in very many contexts, some of which come again
        rows.append(f"{passage(100 + i % 70, 45)} {phrase} {passage(200 + i % 60, 45)}")
    whole = passage(2, 300)
    rows += [whole] * 40 + [whole.lower()]
    w = whole.split()
    for _ in range(60):  # cuts, changed words, pieces put together at every place
        a, b = sorted(rng.sample(range(300), 2))
        cut = w[a:b]
        if cut and rng.random() < .5:
            cut[rng.randrange(len(cut))] = "changed"
        rows.append("\t".join(cut) + "\n" + " ".join(w[rng.randrange(250):]))
    rows += [None, "", " \n ", "one", passage(3, 49), passage(3, 50), passage(3, 51), "a " * 200, "a " * 49, "é x " * 60,
             passage(5, 60) + " " + passage(5, 60), passage(5, 60), passage(6, 25) + " " + passage(7, 25) + " " + passage(8, 25),
             passage(6, 25) + " " + passage(7, 25), passage(7, 25) + " " + passage(8, 25), " ".join(f"w{i * i % 977}" for i in range(20_000))]
    rng.shuffle(rows)
    table = [(i if i % 17 else None, t) for i, t in enumerate(rows)]
    return table + [(5, rows[8]), (5, rows[8]), (9, rows[30])]


@pytest.mark.parametrize("block_rows", [4096, 10, 1])
def test_against_brute_force(spark, block_rows):
    rows = awkward()
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got = remove_repeats(df, block_rows=block_rows).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_other_sizes(spark):
    rows = awkward()[:120]
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA)
    for size in (8, 20):
        got = remove_repeats(df, min_words=size, block_rows=5).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, size)))
    assert remove_repeats(df.limit(0)).collect() == []


def test_factors_cross_their_ends():
    """Two sources that overlap by less than a window: the parse looks at every crossing window."""
    text = np.arange(100)
    index = {}
    for low, high in ((60, 100), (0, 55), (20, 80)):
        part = text[low:high]
        for i in range(len(part) - 9):
            index.setdefault(int(part[i]), (part, i))
    assert factors(list(range(0, 91)), text, index, 10) == [(0, 55), (46, 80), (71, 100)]
