"""The conversation trie against brute force, and tree contraction against recursion."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm.prefix_trie import conversation_trie
from loomgraph.llm.tree_contraction import subtree_totals

SCHEMA = "conv_id long, turn int, role string, text string, id string, parent int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            sha = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, sha), said))
    own = {c: [said for _, said in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own_share = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        saved[node] = own_share + sum(saved[k] for k in kids[node])
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()]


def table():
    rng, rows = random.Random(2), []
    for c in [*range(0, 260), *range(405, 420), 1000, 1001, 1002]:  # the block of 405 has no head
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "tool", None]), rng.choice(["yes", "no", "é", "", None, "é" * 3000])))
    rows += [(2000 + c, t, "user", "the very common conversation") for c in range(0, 150) for t in range(3)]
    rows += [(3000, t, "user", f"step {t}") for t in range(300)] + [(3001, t, "user", f"step {t}") for t in range(280)]
    rows += [(3002, 0, "user", "12"), (3002, 0, "use", "r12"), (3002, None, "user", "first"), (3002, 0, "user", "12")]
    rows += [(None, 0, "user", "nobody's")] * 3
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = conversation_trie(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(df).collect() == []
    assert zlib.crc32(b"8") % 6 > 0  # the only turn belongs to an absent head
    alone = spark.createDataFrame([(8, 0, None, None, "", 0)], SCHEMA)
    assert [tuple(r) for r in conversation_trie(alone).collect()] == brute([(8, 0, None, None)])


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_contraction(spark, shape):
    rng = random.Random(1)
    n = 150
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i),
              "caterpillar": lambda i: i - 1 if i % 3 == 0 else i - i % 3}[shape]
    tree = [(0, None, 1, 5)] + [(i, parent(i), 1, rng.randrange(-9, 9)) for i in range(1, n)] + [(n, None, 1, 4)]
    want = {i: [a, b] for i, _, a, b in tree}
    for i, p, *_ in sorted(tree, key=lambda r: -r[0]):
        if p is not None:
            want[p] = [x + y for x, y in zip(want[p], want[i])]
    got = subtree_totals(spark.createDataFrame(tree, "id long, parent long, a int, b int"), ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == sorted((i, a, b) for i, (a, b) in want.items())
