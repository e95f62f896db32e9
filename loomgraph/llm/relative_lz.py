"""Repeated passages by relative Lempel-Ziv factors.

Every window of ``min_words`` words contains an anchor, the first of its smallest-hashed ``K``-word
pieces, and consecutive windows with one anchor form a run.  Equal windows have equal anchors, so the
reference is indexed by anchor: the reference blocks of a piece are the different runs around it,
each with the earliest document that holds it.  A run that an earlier document holds in whole is one
factor.  What is left, one copy of every run, is parsed against the blocks of its piece in the order
of documents: from left to right, a factor is looked up where the parse stands and extended word by
word as far as its source goes; from there on, every window that crosses the factor's end is looked up
too, so a repeat cut in two by a factor boundary is found.  Shorter factors are literals.  A run joins
the index when all runs of its document are parsed.

A piece with more than ``block_rows`` different runs (a phrase that very many documents share) is not
parsed in one task: its windows are grouped by their hash, which Spark adds up before the shuffle and
can split.  The words of a factor are compared one by one, by 64-bit hashes; in such a crowded piece
windows are told apart by two 64-bit hashes.
"""
from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.kernel import as_long, mix, ngrams, powers, text_chunks, words
from loomgraph.llm.suffix_dedup import minimisers
from loomgraph.session import materialize

#: Words of an anchor.
K = 8
#: Different runs around one piece that one task parses at most.
BLOCK_ROWS = 4096
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_SPAN_TYPE = "array<struct<lo: int, hi: int>>"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key stands for identifier and text, so repeated rows share it."""
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                                 text).cast("binary")))
    return docs.select("doc_id", key.alias("key"), text.alias("text"))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, low, size, piece, run): windows ``low`` up to ``low + size`` share an anchor."""
    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch["text"]):
                found = words(chunk, fold=False)
                h, n = found.hashes, len(found.hashes)
                if n < min_words:
                    continue
                grams = ngrams(h, K)
                best = minimisers(grams, min_words - K + 1)
                at = np.flatnonzero(found.docs[:n - min_words + 1] == found.docs[min_words - 1:])
                if not len(at):
                    continue
                place = best[at]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                size = np.diff(np.append(first, len(at)))
                low, place = at[first], place[first]
                up, down = powers(n + 1)
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(h * up[:-1], out=sums[1:])
                end = low + size - 1 + min_words
                whole = mix((sums[end] - sums[low]) * down[low] + (end - low).astype(np.uint64))
                whole = mix(whole + (place - low).astype(np.uint64))
                doc = found.docs[low]
                row = pa.array(chunk.first + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(row), batch["key"].take(row),
                     pa.array((low - found.bounds[doc]).astype(np.int32)), pa.array(size.astype(np.int32)),
                     as_long(grams[place]), as_long(whole)],
                    ["doc_id", "key", "low", "size", "piece", "run"])

    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, key binary, low int, size int, piece long, run long")


def _blocks(rows: DataFrame, min_words: int) -> DataFrame:
    """(piece, run, late, first, k, words): the word hashes of the runs listed in ``kept``."""
    names = ["piece", "run", "late", "first", "k"]

    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch["text"]):
                found = words(chunk, fold=False)
                hashes = found.hashes.view(np.int64)
                listed = batch["kept"].slice(chunk.first, chunk.last - chunk.first)
                doc = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
                entries = listed.flatten()
                low = found.bounds[doc] + entries.field("low").to_numpy()
                length = entries.field("size").to_numpy() - 1 + min_words
                for part in range(0, len(doc), 1024):
                    some = slice(part, part + 1024)
                    ends = np.cumsum(length[some])
                    flat = np.arange(ends[-1]) + np.repeat(low[some] - ends + length[some], length[some])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(hashes[flat]))
                    fields = entries.slice(part, 1024).flatten()
                    by_name = dict(zip([f.name for f in entries.type], fields))
                    yield pa.RecordBatch.from_arrays([*[by_name[c] for c in names], lists], [*names, "words"])

    first = rows.schema["kept"].dataType.elementType["first"].dataType.simpleString()
    return rows.mapInArrow(run, f"piece long, run long, late boolean, first {first}, k long, words array<long>")


def factors(windows: list[int], sequence: np.ndarray, index: dict, min_words: int) -> list[tuple[int, int]]:
    """The factors (from, to) of one run, from left to right.

    ``index`` names for a window's hash the earliest block that holds it, and where in it.
    """
    found, at = [], 0
    while at < len(windows):
        source = index.get(windows[at])
        length = 0
        if source is not None:
            here, there = sequence[at:], source[0][source[1]:]
            both = min(len(here), len(there))
            differ = here[:both] != there[:both]
            length = int(differ.argmax()) if differ.any() else both
        if length >= min_words:
            found.append((at, at + length))
            at += length - min_words + 1  # the first window that crosses the factor's end
        else:
            at += 1
    return found


def _parse(min_words: int):
    """A task's work: the blocks of a piece come together, in the order of documents."""
    def close(waiting, index):
        for windows, sequence in waiting:
            for i, h in enumerate(windows):
                index.setdefault(h, (sequence, i))
        waiting.clear()

    def run(batches):
        piece, document, index, waiting = None, None, {}, []
        for batch in batches:
            flat = batch["words"].flatten().to_numpy(zero_copy_only=False)
            hashes = ngrams(flat.view(np.uint64), min_words).view(np.int64)
            ends = np.cumsum(batch["words"].value_lengths().to_numpy())
            parsed, spans_of, begin = [], [], 0
            for row, (key, late, first, end) in enumerate(zip(
                    *(batch[c].to_pylist() for c in ("piece", "late", "first")), ends.tolist())):
                if key != piece:
                    piece, document, index, waiting = key, None, {}, []
                if (late, first) != document:  # blocks of one document are no source for each other
                    close(waiting, index)
                    document = late, first
                # the batch is let go of: what is kept is the run's own
                sequence = flat[begin:end].copy()
                windows = hashes[begin:end - min_words + 1].tolist()
                begin = end
                spans = factors(windows, sequence, index, min_words) if index else []
                waiting.append((windows, sequence))
                if spans:
                    parsed.append(row)
                    spans_of.append([{"lo": lo, "hi": hi} for lo, hi in spans])
            if parsed:
                names = ["piece", "run", "late", "first"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c].take(pa.array(parsed)) for c in names], pa.array(spans_of, _SPANS)], [*names, "spans"])

    return run


def _crowded(blocks: DataFrame, min_words: int) -> DataFrame:
    """(piece, run, late, first, spans) for pieces of very many runs: their windows, grouped by hash."""
    def run(batches):
        for batch in batches:
            flat = batch["words"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hashes = ngrams(flat, min_words).view(np.int64)
            length = batch["words"].value_lengths().to_numpy()
            size = length - min_words + 1
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            start = np.cumsum(length) - length
            columns = [batch[c].take(pa.array(row)) for c in ("piece", "run", "late", "first")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at.astype(np.int32)), pa.array(hashes[start[row] + at])],
                ["piece", "run", "late", "first", "at", "window"])

    kind = dict(blocks.dtypes)["first"]
    windows = materialize(blocks.mapInArrow(
        run, f"piece long, run long, late boolean, first {kind}, at int, window long"), "crowded-windows")
    earliest = windows.groupBy("piece", "window").agg(F.min(F.struct("late", "first")).alias("from"),
                                                      F.count(F.lit(1)).alias("n")).where("n > 1")
    return (windows.join(earliest, ["piece", "window"]).where(F.struct("late", "first") > F.col("from"))
            .groupBy("piece", "run", "late", "first")
            .agg(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + min_words).alias("hi"))).alias("spans")))


def duplicate_spans(rows: DataFrame, min_words: int, block_rows: int) -> DataFrame:
    """(key, spans): word ranges (lo, hi) of each row whose windows an earlier document holds."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("first"))
    runs = materialize(_runs(rows, min_words), "lz-runs")
    kinds = materialize(runs.groupBy("piece", "run").agg(
        F.min(F.struct(place.alias("at"), "key", "low", "size")).alias("one"), F.max(place).alias("until"))
        .select("piece", "run", "one.at.late", "one.at.first", "one.key", "one.low", "one.size",
                (F.col("until") > F.col("one.at")).alias("again")), "lz-kinds")
    met = kinds.groupBy("piece").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # one copy of every run that is not alone with its piece; a text lists at most its own runs
    listed = kinds.join(met, "piece").groupBy("key").agg(F.collect_list(F.struct(
        "piece", "run", "late", "first", "k", "low", "size")).alias("kept"))
    blocks = materialize(_blocks(rows.select("key", "text").join(listed, "key").dropDuplicates(["key"]), min_words),
                         "lz-blocks")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = (blocks.where(F.col("k") <= block_rows).drop("k").repartition(parts, "piece")
              .sortWithinPartitions("piece", "late", "first", "run")
              .mapInArrow(_parse(min_words), f"piece long, run long, late boolean, first {_id_type(rows)}, spans {_SPAN_TYPE}"))
    crowded = _crowded(blocks.where(F.col("k") > block_rows).drop("k"), min_words)
    # later holders lose the whole run; its first document what the factors cover
    whole = kinds.where("again").select("piece", "run", "late", "first", F.lit(None).cast(_SPAN_TYPE).alias("spans"))
    verdicts = whole.union(parsed).union(crowded).select(
        "piece", "run", F.struct("late", "first").alias("at"), "spans")
    end = F.col("low") + F.col("size") - 1 + min_words
    covered = F.when(F.col("spans").isNull() & (place > F.col("at")),
                     F.array(F.struct(F.col("low").alias("lo"), end.alias("hi")))).when(
        F.col("spans").isNotNull() & (place == F.col("at")),
        F.transform("spans", lambda s: F.struct((s["lo"] + F.col("low")).alias("lo"), (s["hi"] + F.col("low")).alias("hi"))))
    return (runs.join(verdicts, ["piece", "run"]).select("key", covered.alias("covered")).where("covered IS NOT NULL")
            .select("key", F.inline("covered")).groupBy("key")
            .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))  # at most a text's runs


def _kept(batches):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for batch in batches:
        counts, removed, digests = [], [], []
        for text, spans in zip(batch["text"].cast(pa.binary()), batch["spans"]):
            found = text.as_buffer().to_pybytes().split()  # bytes are split at the six ASCII blanks
            gone = 0
            if spans.is_valid:
                edges = np.zeros(len(found) + 1, np.int64)
                span = spans.values.flatten()
                np.add.at(edges, span[0].to_numpy(), 1)
                np.add.at(edges, span[1].to_numpy(), -1)
                stays = np.cumsum(edges[:-1]) == 0
                gone = len(found) - int(stays.sum())
                counts.append(len(found))
                found = compress(found, stays.tolist())
            else:
                counts.append(len(found))
            removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(found)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names)


def remove_repeats(docs: DataFrame, min_words: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per row of ``docs``.

    Words are split at ASCII blanks and not changed.  A word goes if it lies in a window of
    ``min_words`` words that also starts in a document with a smaller doc_id; ``kept_sha256`` is of the
    words that stay, joined by single blanks.  Windows are judged on the texts as they come.  Null,
    empty and shorter texts lose nothing.  A null doc_id counts as larger than any other; rows of equal
    doc_id are no source for each other; other columns are ignored; no rows, no rows.
    """
    if min_words < K:
        raise ValueError(f"min_words is at least {K}")
    rows = _rows(docs)
    spans = duplicate_spans(rows, min_words, block_rows)
    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        _kept, f"doc_id {_id_type(rows)}, n_words long, n_removed long, kept_sha256 string")
