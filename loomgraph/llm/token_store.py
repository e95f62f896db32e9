"""Token ids in compressed blocks: a static range asymmetric numeral system.

Every block shares one frequency table (each id's count over all documents, scaled to ``2**BITS``).
A block row holds whole documents in ascending order: identifiers, token counts, and chunks.  A chunk
is coded by ``LANES`` interleaved states and starts afresh, so chunks decode on their own; the
checkpoints give where each begins, and each has a CRC-32 of its ids.

Layout of a payload (little-endian): ``uint64`` end state of each lane, then the ``uint32`` words in
the order the decoder takes them.  Checkpoints are triples of ``int64``: first byte, ids, CRC-32.
"""
from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.llm.kernel import row_slices, worker_state
from loomgraph.session import materialize

BITS = 20
LANES = 256
CHUNK_IDS = 1 << 16
SLICE = 1 << 18  # bytes of text tokenized at once
KEPT = 1 << 21  # bytes of words whose ids a worker keeps, some words more; all in all some 50 times that
JOINED = 256  # words that go through the tokenizer as one text, each with a mark behind it
_MARK = "\x01"
# the pieces of the public word vocabulary (a fixed value of its file): none holds a blank
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Frequencies:
    """Scaled counts; every id that occurs has at least one slot of ``2**BITS``."""

    def __init__(self, counts: np.ndarray):
        used = counts > 0
        if used.sum() > 1 << (BITS - 1):
            raise ValueError("too many distinct ids for the table")
        room = (1 << BITS) - int(used.sum())
        total = max(1, int(counts.sum()))
        freq = np.where(used, 1 + (counts.astype(np.float64) / total * room).astype(np.int64), 0)
        if used.any():
            freq[int(counts.argmax())] += (1 << BITS) - int(freq.sum())
        self.counts = counts
        self.freq = freq.astype(np.uint64)
        ends = np.cumsum(freq)
        self.first = (ends - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_chunk(ids: np.ndarray, table: Frequencies) -> bytes:
    state = np.full(LANES, _LOW)
    out = []
    bits, limit_shift = np.uint64(BITS), np.uint64(31 - BITS + 32)
    for first in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        row = ids[first:first + LANES]
        f, c, x = table.freq[row], table.first[row], state[:len(row)]
        over = x >= (f << limit_shift)
        out.append(x[over].astype(np.uint32))
        x = np.where(over, x >> _WORD, x)
        state[:len(row)] = ((x // f) << bits) + x % f + c
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_chunk(data: bytes, n: int, table: Frequencies) -> np.ndarray:
    state = np.frombuffer(data, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * LANES).astype(np.uint64)
    mask, bits, at = np.uint64((1 << BITS) - 1), np.uint64(BITS), 0
    ids = np.empty(n, np.uint32)
    for first in range(0, n, LANES):
        x = state[:min(LANES, n - first)]
        slot = x & mask
        row = table.symbol[slot.astype(np.int64)]
        ids[first:first + len(row)] = row
        x = table.freq[row] * (x >> bits) + slot - table.first[row]
        under = np.flatnonzero(x < _LOW)
        x[under] = (x[under] << _WORD) | words[at:at + len(under)]
        at += len(under)
        state[:len(x)] = x
    if at != len(words):
        raise ValueError("a chunk's words were not used up")
    return ids


@lru_cache
def blanks_only_part(vocabulary: str) -> bool:
    """Whether a text's ids are those of its words between ASCII blanks, one word after another.

    So it is where blanks are in no piece, and nothing that is done to a text before reaches over a blank.
    """
    with open(vocabulary, encoding="utf-8") as f:
        said = json.load(f)

    def steps(key, of):
        step = said.get(key) or {"type": "Sequence", of: []}
        return step[of] if step["type"] == "Sequence" else [step]

    changes = [x for x in steps("normalizer", "normalizers") if x["type"] not in ("NFC", "Lowercase")]
    first = [*steps("pre_tokenizer", "pretokenizers"), {}][0]
    return (all(x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in changes)
            and first == {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or x["content"].split() != [x["content"]]
                        for x in said["added_tokens"])
            and not said["truncation"] and not said["padding"] and not said["model"].get("dropout"))


class _Places(dict):
    """Numbers of words in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def _appended(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The first ``n`` values of ``held`` and ``more``, with room for others behind them."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty(n + len(more), held.dtype)])
    held[n:n + len(more)] = more
    return held


class WordIds:
    """The ids of texts, word by word: the tokenizer codes a word once for as long as it is kept.

    Beyond ``KEPT`` bytes of words, those used most stay, up to half of that.
    """

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.mark = self._ids([_MARK])[0]
        # a blank, which is no word, stands for the end of a text
        self.places, self.bytes = _Places({b" ": 0}), 0
        self.ids, self.n_ids = np.array([end_id], np.int32), 1
        self.first, self.lengths, self.uses = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(
            texts, add_special_tokens=False)])

    def _forget(self) -> None:
        words = list(self.places)
        sizes, uses = np.fromiter(map(len, words), np.int64, len(words)), self.uses
        order = np.argsort(-uses[1:], kind="stable") + 1
        order = order[(np.cumsum(sizes[order]) <= KEPT // 2) & (uses[order] > 1)]
        kept = np.concatenate([[0], np.sort(order)])
        lengths, first = self.lengths[kept], self.first[kept]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1])]
        self.first, self.lengths, self.n_ids = ends - lengths, lengths, len(self.ids)
        # halved: words of earlier texts make room for those of later ones
        self.places, self.bytes, self.uses = _Places(zip((words[i] for i in kept), range(len(kept)))), int(
            sizes[kept].sum()), uses[kept] >> 1

    def _learn(self, new: list[bytes], known: int) -> None:
        """Code the words ``new``, joined by a mark that parts their ids again; ``known`` words are there."""
        texts = [w.decode() for w in new]
        odd = [i for i, t in enumerate(texts) if _MARK in t]
        coded = self._ids([f" {_MARK} ".join(["" if _MARK in t else t for t in texts[i:i + JOINED]] + [""])
                           for i in range(0, len(texts), JOINED)])
        lengths = np.diff(np.flatnonzero(coded == self.mark), prepend=-1) - 1
        coded = coded[coded != self.mark]
        if odd:
            parts = np.split(coded, np.cumsum(lengths)[:-1])
            for i in odd:
                parts[i] = self._ids([texts[i]])
            coded, lengths = np.concatenate(parts), np.array([len(x) for x in parts])
        self.first = _appended(self.first, known, self.n_ids + np.cumsum(lengths) - lengths)
        self.lengths = _appended(self.lengths, known, lengths)
        self.ids = _appended(self.ids, self.n_ids, coded)
        self.n_ids += len(coded)

    def code(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and where each text's ids end."""
        if self.bytes >= KEPT:
            self._forget()
        words = [t.split() + [b" "] for t in texts]
        n, known = np.cumsum([len(w) for w in words]), len(self.places)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, int(n[-1]))
        if len(self.places) > known:
            new = list(islice(reversed(self.places), len(self.places) - known))[::-1]
            self.bytes += sum(map(len, new))
            self._learn(new, known)
        uses = np.bincount(at, minlength=len(self.places))
        uses[:known] += self.uses
        self.uses = uses
        sizes, first = self.lengths[at], self.first[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])], ends[n - 1]


@lru_cache(4)
def _word_ids(tokenizer, end_id: int) -> WordIds:
    """One for each tokenizer of a worker."""
    return WordIds(tokenizer, end_id)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids): whole texts (null: empty) with ``end_id`` after each.

    Texts go through the tokenizer about ``SLICE`` bytes at a time, on the task's own thread: what it keeps
    of a token besides its id takes some hundred bytes, and threads of its own keep memory of their own.
    Where blanks only part words, each of a slice's words goes through it once (:class:`WordIds`).
    """
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer
        tokenizer = worker_state(("tokenizer", vocabulary), lambda: Tokenizer.from_file(vocabulary))
        known = _word_ids(tokenizer, end_id) if blanks_only_part(vocabulary) else None
        for batch in batches:
            for part in row_slices(batch, limit=SLICE):
                if known is None:
                    coded = [np.array(e.ids + [end_id], np.int32) for e in tokenizer.encode_batch_fast(
                        [t or "" for t in part["text"].to_pylist()], add_special_tokens=False)]
                    ids, ends = np.concatenate(coded), np.cumsum([len(x) for x in coded])
                else:
                    ids, ends = known.code([t or b"" for t in part["text"].cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def frequencies(rows: DataFrame, ids: int) -> Frequencies:
    """The shared table, from all rows; at most ``ids`` counts reach the driver."""
    def count(batches):
        sums = np.zeros(ids, np.int64)
        for batch in batches:
            sums += np.bincount(batch["ids"].flatten().to_numpy(zero_copy_only=False), minlength=ids)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["id", "n"])

    got = (rows.select("ids").mapInArrow(count, "id long, n long")
           .groupBy("id").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(ids, np.int64)
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    return Frequencies(counts)


_BLOCK = ("shard int, block int, n_ids long, lengths array<long>, checkpoints array<long>, "
          "payload binary")


def write_blocks(rows: DataFrame, table: Frequencies) -> DataFrame:
    """Write (doc_id, ids) in ascending order as blocks; null identifiers come first."""
    key = rows.schema["doc_id"].dataType
    shared = rows.sparkSession.sparkContext.broadcast(table.counts)  # one number per id of the vocabulary

    def run(batches):
        from pyspark import TaskContext
        table, shard, block = Frequencies(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, parts, size = [], [], 0

        def flush():
            flat = np.concatenate(parts)
            data, marks, at = [], [], 0
            for first in range(0, len(flat), CHUNK_IDS):
                chunk = flat[first:first + CHUNK_IDS]
                data.append(encode_chunk(chunk, table))
                marks += [at, len(chunk), zlib.crc32(chunk.astype("<u4").tobytes())]
                at += len(data[-1])
            values = ([shard], [block], [len(flat)], [[len(p) for p in parts]], [marks], [b"".join(data)])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            ids = pa.concat_arrays(doc_ids)
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, values, types), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                ["shard", "block", "n_ids", "lengths", "checkpoints", "payload", "doc_ids"])

        for batch in batches:
            ids = batch["ids"]
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            for i in range(len(ids)):
                doc_ids.append(batch["doc_id"].slice(i, 1))
                parts.append(flat[ends[i]:ends[i + 1]])
                size += len(parts[-1])
                if size >= CHUNK_IDS:
                    yield flush()
                    doc_ids, parts, size, block = [], [], 0, block + 1
        if parts:
            yield flush()

    spark = rows.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    return materialize(ordered.mapInArrow(run, f"{_BLOCK}, doc_ids array<{key.simpleString()}>"), "blocks")


def read_blocks(blocks: DataFrame, table: Frequencies) -> DataFrame:
    """(doc_id, start, ids) of every document in the blocks; a bad checksum is an error."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(table.counts)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("shard")
    sizes["base"] = sizes["n"].cumsum() - sizes["n"]  # one row per shard
    bases = spark.createDataFrame([(int(s), int(b)) for s, b in zip(sizes["shard"], sizes["base"])],
                                  "shard int, base long")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.select("shard", "block", "n_ids")
              .withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
              .join(bases, "shard").select("shard", "block", (F.col("inner") + F.col("base")).alias("start")))
    placed = blocks.join(starts, ["shard", "block"])
    kind = placed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        table = Frequencies(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch["payload"][row].as_py()
                marks = np.array(batch["checkpoints"][row].as_py(), np.int64).reshape(-1, 3)
                edges = [*marks[:, 0], len(payload)]
                flat = []
                for (first, n, crc), last in zip(marks, edges[1:]):
                    flat.append(decode_chunk(payload[first:last], int(n), table))
                    if zlib.crc32(flat[-1].astype("<u4").tobytes()) != crc:
                        raise ValueError("a chunk does not match its checksum")
                ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
                ends = np.concatenate([[0], np.cumsum(batch["lengths"][row].as_py())]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_ids"][row].values, pa.array(ends[:-1] + batch["start"][row].as_py()),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    ["doc_id", "start", "ids"])

    return placed.mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of decoded documents."""
    def run(batches):
        for batch in batches:
            ids = [np.asarray(x.values if x.is_valid else [], "<u4") for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, ids: int = 1 << 17) -> DataFrame:
    """Tokenize, write as blocks, read back: (doc_id, start, ids) in ascending ``doc_id`` order.

    A null text is empty and has the end id only.  Rows that share an identifier follow each other
    in order of their ids; other columns are ignored; no rows give no rows.
    """
    rows = materialize(tokenize(docs, vocabulary, end_id), "ids")
    table = frequencies(rows, ids)
    return read_blocks(write_blocks(rows, table), table)
