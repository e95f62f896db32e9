"""Language-model scores from a log-frequency Bloom filter.

The level of a count is ``1 + floor(log2(count))``.  An n-gram is put into the filter once for each
level up to its own, so a count is read back by probing levels until one is missing; errors can only
overstate.  All n-grams are held.  The filter has ``BITS_PER_ENTRY`` bits for each entry, so it grows
with the corpus; beyond ``max_bytes`` it is cut into parts by hash, each built, broadcast and probed
in a pass of its own.

Probabilities interpolate the orders.  The base score (add-half unigrams) uses exact counts: those of
the most frequent words are broadcast, the others' come by join.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.kernel import mix, text_chunks, words
from loomgraph.session import materialize

BITS_PER_ENTRY = 12
PROBES = 4
#: Slices of the filter at most, so that the rows of its lists grow with the n-grams alone; the fewest 8-byte
#: words of a slice, and words brought to the driver at once (64 MB).
SLICES = 1 << 10
SLICE = 1 << 10
WORDS = 1 << 23
#: Words whose exact counts are broadcast (16 bytes each); the others meet theirs in a join.
FREQUENT = 1 << 17
#: N-grams whose bits are put together before they are shuffled.
GATHERED = 1 << 19
#: Weight of the longer history, per order above the first.
MIXING = 0.3
_END = np.uint64(0xE2D0E2D0E2D0E2D1)


def _tokens(batch):
    """(first document, token hashes with an end after each document, bounds) per chunk."""
    for chunk in text_chunks(batch["text"]):
        found = words(chunk)
        n = chunk.last - chunk.first
        hashes = np.insert(found.hashes, found.bounds[1:], _END)
        yield chunk.first, hashes, found.bounds + np.arange(n + 1)


def _history(hashes: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each token; 0 where the document has begun too late."""
    start = np.repeat(bounds[:-1], np.diff(bounds))
    out = mix(hashes ^ np.uint64(order))
    for back in range(1, order):
        moved = np.roll(hashes, back)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + moved)
    out[np.arange(len(hashes)) - start < order - 1] = 0
    return out


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(size, gram, n) over whole texts."""
    def run(batches):
        for batch in batches:
            for _, hashes, bounds in _tokens(batch):
                for size in range(1, order + 1):
                    grams = _history(hashes, bounds, size)
                    got, n = np.unique(grams[grams != 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(got), size, np.int32)), pa.array(got.view(np.int64)), pa.array(n)],
                        ["size", "gram", "n"])

    return (docs.select("text").mapInArrow(run, "size int, gram long, n long")
            .groupBy("size", "gram").agg(F.sum("n").alias("n")))


def _walk(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(grams + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    return base, mix(base) | np.uint64(1)


def _bits(grams: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    base, step = _walk(grams, level)
    return [((base + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(PROBES)]


def n_parts(counts: DataFrame, max_bytes: int) -> int:
    """Parts of the filter, so that each has about ``max_bytes`` at most."""
    entries = counts.agg(F.coalesce(F.sum(_level()), F.lit(0))).first()[0]
    return max(1, -(-int(entries) * BITS_PER_ENTRY // (8 * max_bytes)))


def _level():
    return 1 + F.floor(F.log2(F.col("n").cast("double")))


def _gathered(batches):
    """(n-grams, levels), about ``GATHERED`` at a time."""
    grams, levels, held = [], [], 0
    for batch in batches:
        grams.append(batch["gram"].to_numpy().view(np.uint64))
        levels.append(batch["level"].to_numpy())
        held += batch.num_rows
        if held >= GATHERED:
            yield np.concatenate(grams), np.concatenate(levels)
            grams, levels, held = [], [], 0
    if held:
        yield np.concatenate(grams), np.concatenate(levels)


def build_filter(counts: DataFrame, part: int = 0, parts: int = 1) -> np.ndarray:
    """One part of the filter, brought to the driver as bytes.

    A slice is made in one task from its bits, which travel as lists: one row for each slice and
    ``GATHERED`` n-grams.
    """
    counts = counts.where(F.pmod("gram", F.lit(parts)) == part)
    entries = counts.agg(F.coalesce(F.sum(_level()), F.lit(0))).first()[0]
    size = max(1024, -(-int(entries) * BITS_PER_ENTRY // 64) * 64)
    wide = max(SLICE, -(-size // (64 * SLICES)))

    def run(batches):
        for grams, levels in _gathered(batches):
            bits = [x for level in range(1, int(levels.max()) + 1)
                    for x in _bits(grams[levels >= level], level, size)]
            where = np.sort(np.concatenate(bits))
            slices = where // (64 * wide)
            first = np.flatnonzero(np.diff(slices, prepend=-1))
            lists = (where % (64 * wide)).astype("<u4").tobytes()
            ends = [*(4 * first).tolist(), len(lists)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices[first]), pa.array([lists[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], ["slice", "bits"])

    def dense(group: pa.Table) -> pa.Table:  # a slice has few bits more than PROBES / BITS_PER_ENTRY of its size
        held = np.zeros(64 * wide, bool)
        for bits in group["bits"]:
            held[np.frombuffer(bits.as_buffer(), "<u4")] = True
        packed = np.packbits(held, bitorder="little").tobytes()
        return pa.table({"slice": group["slice"][:1], "held": pa.array([packed], pa.binary())})

    slices = materialize(
        counts.select("gram", _level().alias("level")).mapInArrow(run, "slice long, bits binary")
        .groupBy("slice").applyInArrow(dense, "slice long, held binary"), "filter")
    n = -(-size // (64 * wide))
    table, rows = np.zeros(n * wide, np.uint64), max(1, WORDS // wide)
    for low in range(0, n, rows):
        got = slices.where(F.col("slice").between(low, low + rows - 1)).toArrow()
        for at, held in zip(got["slice"].to_pylist(), got["held"]):
            table[at * wide:(at + 1) * wide] = np.frombuffer(held.as_buffer(), np.uint64)
    return table[:size // 64]


def probe(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Counts as the filter tells them: the middle of the highest level found, 0 if none."""
    unique, back = np.unique(grams, return_inverse=True)
    level = np.zeros(len(unique), np.int64)
    alive, at = np.flatnonzero(unique), 1
    while len(alive) and at < 64:
        base, step = _walk(unique[alive], at)
        for k in range(PROBES):  # most of those not held are out after the first bit
            bit = (base + np.uint64(k) * step) % np.uint64(len(table) * 64)
            held = (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
            alive, base, step = alive[held], base[held], step[held]
        level[alive] = at
        at += 1
    low = np.exp2(np.maximum(level - 1, 0))
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.5 * low - 0.5))[back]


def score(docs: DataFrame, training: DataFrame, order: int = 2, max_bytes: int = 1 << 30) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Both scores are log10 probabilities of the whole text with its end token.  A null text is empty;
    repeated rows each get their score; other columns are ignored; without training rows every token
    is unknown; no rows give no rows.
    """
    counts = materialize(ngram_counts(training, order), "ngram-counts")
    one = counts.where("size = 1")
    total, distinct = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    spark = docs.sparkSession
    parts = n_parts(counts, max_bytes)
    room = total + 0.5 * (distinct + 1)
    top = one.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram", "n").orderBy("gram").toArrow()
    often = spark.sparkContext.broadcast((top["gram"].to_numpy(), top["n"].to_numpy()))
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counted(batch, shared, part):
        """Tokens of a batch with their counts from this part of the filter and those before."""
        table = shared.value
        for first, hashes, bounds in _tokens(batch):
            grams = [_history(hashes, bounds, size) for size in range(1, order + 1)]
            seen = []
            for g in grams:
                here = (g.view(np.int64) % parts == part) if parts > 1 else np.ones(len(g), bool)
                seen.append(probe(table, np.where(here, g, np.uint64(0))))
            if part:
                before = batch["seen"].slice(first, len(bounds) - 1).flatten().to_numpy()
                seen = list(np.array(seen) + before.reshape(-1, order).T)
            yield first, bounds, grams, seen

    for part in range(parts - 1):
        def gather(batches, part=part, shared=spark.sparkContext.broadcast(build_filter(counts, part, parts))):
            for batch in batches:
                for first, bounds, _, seen in counted(batch, shared, part):
                    n = len(bounds) - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(first, n), batch["text"].slice(first, n),
                         pa.ListArray.from_arrays(pa.array((bounds * order).astype(np.int32)), pa.array(np.array(seen).T.ravel()))],
                        ["doc_id", "text", "seen"])

        rows = materialize(rows.mapInArrow(gather, f"doc_id {kind}, text string, seen array<double>"), "seen")
    shared = spark.sparkContext.broadcast(build_filter(counts, parts - 1, parts))

    def run(batches):
        for batch in batches:
            for first, bounds, grams, seen in counted(batch, shared, parts - 1):
                p = (seen[0] + 0.5) / room
                for size in range(2, order + 1):
                    context = np.concatenate([[0.0], seen[size - 2][:-1]])
                    context[grams[size - 1] == 0] = 0
                    known = context > 0
                    ratio = np.minimum(1, seen[size - 1][known] / context[known])
                    p[known] = (1 - MIXING) * p[known] + MIXING * ratio
                logs = np.add.reduceat(np.log10(p), bounds[:-1])
                n = len(bounds) - 1
                found = [np.unique(grams[0][bounds[i]:bounds[i + 1]], return_counts=True) for i in range(n)]
                at = np.repeat(np.arange(n), [len(got) for got, _ in found])
                gram, times = (np.concatenate(x) for x in zip(*found))
                gram = gram.view(np.int64)
                place = np.minimum(np.searchsorted(often.value[0], gram), max(0, len(often.value[0]) - 1))
                hit = often.value[0][place] == gram if len(often.value[0]) else np.zeros(len(gram), bool)
                base = times[hit] * np.log10((often.value[1][place[hit]] + 0.5) / room)
                rest = np.concatenate([[0], np.cumsum(np.bincount(at[~hit], minlength=n))]).astype(np.int32)
                tokens = pa.StructArray.from_arrays([pa.array(gram[~hit]), pa.array(times[~hit])], ["gram", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, n), pa.array(np.diff(bounds)), pa.array(logs),
                     pa.array(np.bincount(at[hit], times[hit], n).astype(np.int64)), pa.array(np.bincount(at[hit], base, n).astype(float)),
                     pa.ListArray.from_arrays(pa.array(rest), tokens)],
                    ["doc_id", "n_tokens", "score", "n_often", "base_often", "tokens"])

    scored = materialize(rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, score double, n_often long, base_often double, "
             "tokens array<struct<gram:bigint,n:bigint>>"),
        "scored").withColumn("row", F.monotonically_increasing_id())
    parts = scored.select("row", F.explode("tokens").alias("token")).select("row", "token.gram", "token.n")
    exact = one.select("gram", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    base = (parts.join(exact, "gram", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(room))).alias("base_rare")))
    return scored.drop("tokens").join(base, "row", "left").select(
        "row", "doc_id", "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_often") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), "score")
