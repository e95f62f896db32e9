"""Exact de-duplication against brute force, and its edge cases."""
from collections import defaultdict
from hashlib import sha256

import pytest

from loomgraph.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, digest string, run int"  # two names clash with inner columns


def brute(rows, keep):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "largest" else min)(known) if known else None
        out += [(i, stays, len(ids), sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "z"), (6, "é" * 90000),
        (7, "é" * 90000), (2, "b"), (8, "A"), (9, "a ")] + [(100 + i, "hot") for i in range(200)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in,slice_rows", [(2, 7), (8, 200_000)])
def test_matches_brute_force(spark, keep, fan_in, slice_rows):
    rows = [(i, t, "x", 1) for i, t in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_duplicates(docs, keep, fan_in=fan_in, slice_rows=slice_rows).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got),
                  key=repr) == brute(rows, keep)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in ROWS})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unknown_side(spark):
    with pytest.raises(ValueError):
        exact_duplicates(spark.createDataFrame([], SCHEMA), "first")
