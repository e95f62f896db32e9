"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents of equal shingle sets are one class from the start, named by the digest of the set.  Whole
sets are larger than their texts, so they are never stored for all documents: each pass makes them from
the texts again, and only sets that a candidate pair needs are written.  For the product only the head of a
class's set is needed: in any common order of the shingles, two sets that are similar enough share
one of their first ``n - ceil(t * n) + 1``.  The order puts shingles of rarely filled counters first
(a count table of fixed size), so the common passages are at the tails.

The product is taken twice over.  First each column (one shingle's classes) links only neighbours, by size and
then in a drawn order; verified links merge classes into components.  Then only pairs from different
components meet, at the first shingle they share: a row knows the ``BEFORE`` shingles ahead of its own, and
a pair that shares one of those has met already.  Pairs inside a component can add nothing to it, so no group
of near copies is expanded into its pairs and no link between components is lost.

Before whole sets are compared, a pair must pass its marks: parities of the shingles by hash, some bits a
shingle.  Each bit in which two marks differ stands for another shingle that only one of the sets has, which
bounds their overlap from above.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.llm.components import components
from loomgraph.llm.kernel import ngrams, text_chunks, words
from loomgraph.session import materialize, write_bucketed

#: Counters of the table that orders shingles; the table takes 8 bytes each, whatever the input.
COUNTERS = 1 << 17
#: Shingles ahead of its own that a row of the product carries.
BEFORE = 8


class Sets(NamedTuple):
    """The shingle sets of the rows ``first`` up to ``last`` of a batch, one after another."""
    first: int
    last: int
    flat: np.ndarray
    ends: np.ndarray
    class_ids: pa.Array


def chunk_sets(column: pa.Array, size: int) -> Iterator[Sets]:
    """Sorted distinct hashes of each whole text, some texts at a time; memory is bound by the chunk."""
    for chunk in text_chunks(column):
        found = words(chunk)
        grams = ngrams(found.hashes, size)
        sets, marks = [np.zeros(0, np.int64)], []
        for i in range(chunk.last - chunk.first):
            low, high = found.bounds[i], found.bounds[i + 1]
            if high - low >= size:
                got = grams[low:high - size + 1]
            elif high > low:
                got = ngrams(found.hashes[low:high], int(high - low))
            else:
                got = np.zeros(0, np.uint64)
            got = np.sort(got.view(np.int64))  # np.unique takes several times as long
            got = got[np.diff(got, prepend=~got[:1]) != 0]
            sets.append(got)
            marks.append(hashlib.md5(got.tobytes()).digest() if len(got) else None)
        ends = np.cumsum([len(x) for x in sets], dtype=np.int64)
        yield Sets(chunk.first, chunk.last, np.concatenate(sets), ends, pa.array(marks, pa.binary()))


def set_marks(sets: Sets) -> pa.Array:
    """Each set's parities, in as many bits as the next power of two above twice its size, 64 at least."""
    n = np.diff(sets.ends)
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(ends[:-1], n) + (sets.flat & np.repeat(bits - 1, n))
    odd = (np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((ends // 64).astype(np.int32)),
                                    pa.array(np.packbits(odd, bitorder="little").view("<i8")))


def shingle_sets(docs: DataFrame, size: int, whole: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id) and ``shingles``, or else ``marks``: the sets of whole texts, by their digests."""
    names = ["doc_id", "n_shingles", "class_id", "shingles" if whole else "marks"]

    def run(batches):
        for batch in batches:
            for got in chunk_sets(batch["text"], size):
                last = pa.ListArray.from_arrays(
                    pa.array(got.ends.astype(np.int32)), pa.array(got.flat)) if whole else set_marks(got)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(got.first, got.last - got.first),
                     pa.array(np.diff(got.ends)), got.class_ids, last], names)

    rows = docs.select("doc_id", "text")
    key = rows.schema["doc_id"].dataType.simpleString()
    kinds = [key, "long", "binary", "array<long>"]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def heads(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(shingle, class_id, n, at): the heads of the classes' sets, rare shingles first, once a class."""
    def slots(flat):
        return (flat.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)

    def count(batches):
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for got in chunk_sets(batch["text"], size):
                table += np.bincount(slots(got.flat), minlength=COUNTERS)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], ["slot", "n"])

    counts = (docs.select("text").mapInArrow(count, "slot long, n long")
              .groupBy("slot").agg(F.sum("n").alias("n"))).toArrow()  # at most COUNTERS rows
    table = np.zeros(COUNTERS, np.int64)
    table[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def cut(batches):
        seen = set()  # of this task: copies in it give their head once, the rest go after the shuffle
        for batch in batches:
            for got in chunk_sets(batch["text"], size):
                often = shared.value[slots(got.flat)]
                parts = []
                for low, high, name in zip(got.ends[:-1], got.ends[1:], got.class_ids.to_pylist()):
                    n = 0 if name in seen else int(high - low)
                    seen.add(name)
                    order = np.argsort(often[low:low + n], kind="stable")  # equal counts: by hash
                    parts.append(low + order[:n + (-percent * n) // 100 + 1 if n else 0])
                lengths = np.array([len(x) for x in parts], np.int64)
                row = np.repeat(np.arange(len(parts)), lengths)
                at = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.flat[np.concatenate(parts).astype(np.int64)]), got.class_ids.take(pa.array(row)),
                     pa.array(np.diff(got.ends)[row]), pa.array(at)],
                    ["shingle", "class_id", "n", "at"])

    # one shuffle serves the distinct and the windows over a shingle's column
    return docs.select("text").mapInArrow(
        cut, "shingle long, class_id binary, n long, at long").repartition("shingle").distinct()


def _required(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes: 100 * o >= percent * (n + m - o)."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent))


def _folded(marks: Column, length: Column) -> Column:
    """Marks as they were with fewer bits: ``length`` longs, a power of two."""
    return F.when(F.size(marks) == length, marks).otherwise(F.transform(
        F.sequence(F.lit(1), length), lambda i: F.aggregate(
            F.sequence(i, F.size(marks), length), F.lit(0).cast("long"),
            lambda sum_, k: sum_.bitwiseXOR(F.element_at(marks, k)))))


def plausible(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose marks do not rule out that they are similar enough; no such pair is lost."""
    marks = (members.where("class_id is not null").groupBy("class_id")
             .agg(F.first("n_shingles").alias("n"), F.first("marks").alias("m")))
    both = (pairs.join(marks.toDF("a", "na", "ma"), "a").join(marks.toDF("b", "nb", "mb"), "b"))
    length = F.least(F.size("ma"), F.size("mb"))
    differ = F.aggregate(F.zip_with(_folded(F.col("ma"), length), _folded(F.col("mb"), length),
                                    lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda sum_, x: sum_ + x)
    n = F.col("na") + F.col("nb")
    # the overlap is (n - differ) / 2 at most
    return (both.where(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
            .where((n - differ) * (100 + percent) >= 2 * percent * n).select("a", "b"))


def apart(head: DataFrame, part: DataFrame) -> DataFrame:
    """Head rows of the shingles that several components have, with the component (``part``: node, component)."""
    placed = materialize(head.join(part.withColumnRenamed("node", "class_id"), "class_id", "left")
                         .select("shingle", "class_id", "n", "at",
                                 F.coalesce("component", "class_id").alias("component")), "placed")
    mixed = (placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("shingle"))
    return placed.join(mixed, "shingle", "left_semi")


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the classes in different components that share a head shingle, most pairs once only.

    ``rows``: shingle, class_id, n, at, component.  At their first common shingle, two sets that are similar
    enough have all they must share still ahead of them, and none of the shingles before is common.
    """
    ahead = Window.partitionBy("class_id").orderBy("at").rowsBetween(-BEFORE, -1)
    rows = materialize(rows.withColumn("ahead", F.collect_list("shingle").over(ahead)), "open-heads")
    x, y = rows.alias("x"), rows.alias("y")
    least = _required(F.col("x.n"), F.col("y.n"), percent)
    return (x.join(y, (F.col("x.shingle") == F.col("y.shingle"))
                   & (F.col("x.component") != F.col("y.component"))
                   & (F.col("x.class_id") < F.col("y.class_id"))
                   & (F.least("x.n", "y.n") * 100 >= percent * F.greatest("x.n", "y.n"))
                   & (F.col("x.n") - F.col("x.at") >= least) & (F.col("y.n") - F.col("y.at") >= least)
                   & ~F.arrays_overlap("x.ahead", "y.ahead"))
            .select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")))


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the (a, b) pairs whose sets are similar enough; one document a class gives its set."""
    pairs = materialize(plausible(pairs, members, percent), "plausible")
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct(), "used")
    named = (members.join(used, "class_id", "left_semi").groupBy("class_id")
             .agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    d, k = docs.select("doc_id", "text").alias("d"), named.alias("k")
    texts = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    # in buckets by class: where a pair meets its sets, only the pair travels, with the first set to the second
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = write_bucketed(shingle_sets(texts, size).where("class_id is not null").select("class_id", "shingles"),
                            "sets", ["class_id"], buckets)
    sets = spark.table(stored).groupBy("class_id").agg(F.first("shingles").alias("shingles"))
    left = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    # rounds of about as many pairs as there are sets: what is shuffled at once does not grow with the pairs
    rounds, found = max(1, -(-pairs.count() // max(1, used.count()))), []
    for i in range(rounds):
        both = (pairs.select("a", "b").where(F.pmod(F.xxhash64("b"), F.lit(rounds)) == i)
                .join(left, "a").join(right, "b"))
        found.append(materialize(
            both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), overlap.alias("o"))
            .where(F.col("o") * 100 >= percent * (F.col("n") - F.col("o"))).select("a", "b"), "links"))
    return reduce(DataFrame.union, found)


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) per document.

    ``component_id`` is the smallest identifier reachable over links of at least ``percent``
    similarity of the ``size``-word shingle sets.  A document without words (or a null text) links
    with nothing.  Null identifiers never name a component that has another; repeated rows link as
    equal sets do; other columns are ignored; no rows give no rows.
    """
    table = materialize(shingle_sets(docs, size, whole=False), "members")
    column = Window.partitionBy("shingle")
    head = materialize(heads(docs, percent, size).withColumn("df", F.count(F.lit(1)).over(column))
                       .where("df > 1").withColumn("before", F.lag(F.struct("class_id", "n")).over(
                           column.orderBy("n", "class_id"))), "heads")
    fits = F.least("n", "before.n") * 100 >= percent * F.greatest("n", "before.n")
    chain = (head.where(F.col("before").isNotNull() & fits)
             .select(F.least("class_id", "before.class_id").alias("a"),
                     F.greatest("class_id", "before.class_id").alias("b")).distinct())
    links = verified(materialize(chain, "chain"), docs, table, percent, size)
    open_ = apart(head, components(links))
    # other neighbours, drawn anew in each column: a large group of near copies is one component before pairs are made
    before = F.lag(F.struct("class_id", "n", "component")).over(column.orderBy(F.xxhash64("class_id", "shingle"), "class_id"))
    chain = (open_.withColumn("before", before).where(F.col("before.component") != F.col("component")).where(fits)
             .select(F.least("class_id", "before.class_id").alias("a"),
                     F.greatest("class_id", "before.class_id").alias("b")).distinct())
    links = materialize(links.union(verified(materialize(chain, "chain"), docs, table, percent, size)), "chain-links")
    open_ = apart(head, components(links))
    reach = meetings(open_, percent).distinct()
    more = verified(materialize(reach, "pairs"), docs, table, percent, size)
    part = materialize(components(materialize(links.union(more), "all-links")), "components")
    linked = (table.join(part.withColumnRenamed("node", "class_id"), "class_id", "left")
              .withColumn("component", F.coalesce("component", "class_id")))
    named = (linked.where("component is not null").groupBy("component")
             .agg(F.min("doc_id").alias("component_id")))
    return linked.join(named, "component", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "class_id")
