"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For every prefix of a word the last token of its encoding is unique.  An automaton reports each
piece that ends at a position; the one that is compatible with the last token of the prefix before
it (the two, written together, encode to just these two) is stored.  Ids are then read backwards
through the table.  Work is linear in the text, for words of any length.

Pieces with a space marker only at their front let words be encoded apart; the model is checked for
that.  Word and pair results are kept per Python worker in caches of bounded size.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.kernel import row_slices, worker_state

#: Entries of the word and pair caches; a full cache is emptied, results do not depend on it.
CACHE = 1 << 20
_CACHED_WORD = 64
_MARK = "▁"
_WORDS = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")


class PieceTable:
    """The pieces of one model, their automaton, and the compatibility of pairs."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, int] = {}
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)
                    or self.sp.is_unused(i)):
                self.rank[self.sp.id_to_piece(i)] = i
        self.score = {p: self.sp.get_score(i) for p, i in self.rank.items()}
        if any(_MARK in p.lstrip(_MARK) for p in self.rank):
            raise ValueError("a piece of this model crosses a word boundary")
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        # characters a longer piece uses take part even where they are no piece themselves
        self.chars = {c for p in self.rank for c in p}
        chars = sorted(self.chars)
        count = Counter(self.score.values())
        #: pieces of one score (runs of blanks): among them the place decides, not the age
        self.tied = {p for p, s in self.score.items() if count[s] > 1 and len(p) > 1}
        longer = sorted((p for p in self.rank if len(p) > 1), key=lambda p: -self.score[p])
        #: when a piece comes into being (characters first), and its two halves
        self.born = {p: i for i, p in enumerate([*chars, *longer])}
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in longer:
            parts = self.merged(piece, 2)
            if len(parts) == 2 and "".join(parts) in self.rank:
                self.halves[piece] = parts[0], parts[1]
        for piece in [*chars, *self.halves]:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The parts of a short string, merging the best-scored neighbours first, down to ``stop``."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        pair = left, right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            both = left + right
            tied = any(both[i:j] in self.tied for i in range(len(both)) for j in range(i + 2, len(both) + 1))
            known = self.pairs[pair] = (self.merged(both) == [left, right] if tied
                                        else self._stays_apart(left, right))
        return known

    def _stays_apart(self, left: str, right: str) -> bool:
        """Undo the merges of both pieces, youngest first, along the seam between them: the pair is
        compatible if at no time the parts that touch would have been merged before that undoing."""
        born, halves, limit = self.born, self.halves, len(self.born)
        while True:
            joint = born.get(left + right)
            if joint is not None and joint < limit:
                return False
            # of equal age the left one merges first, so the right one is undone first
            undo_left = left in halves and (right not in halves or born[left] > born[right])
            if undo_left:
                limit = born[left]
                left = halves[left][1]
            elif right in halves:
                limit = born[right] + 1
                right = halves[right][0]
            else:
                return True

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word, through the table of last tokens."""
        ids = self.words.get(word)
        if ids is not None:
            return ids
        last: list[str | None] = [None] * (len(word) + 1)
        for end, piece in self.automaton.iter(word):
            at = end + 1
            if last[at] is None:
                start = at - len(piece)
                before = last[start]
                # at the word's front, or behind a character no piece has, nothing can clash
                apart = start == 0 or before is None and word[start - 1] not in self.chars
                if apart or before is not None and self.compatible(before, piece):
                    last[at] = piece
        out: list[int] = []
        at = len(word)
        while at:
            piece = last[at]
            if piece is None:
                piece = word[at - 1]
                if piece in self.chars:
                    raise ValueError(f"no last token for a prefix of {word!r}")
            at -= len(piece)
            known = self.rank.get(piece)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.fallback(piece))
        ids = tuple(reversed(out))
        if len(word) <= _CACHED_WORD:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = ids
        return ids

    def fallback(self, char: str) -> list[int]:
        """The byte pieces of a character, last byte first."""
        return [self.bytes[b] for b in reversed(char.encode())]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in _WORDS.findall(self.sp.normalize(text)):
            ids.extend(self.word(word))
        return ids


def _table(path: str) -> PieceTable:
    return worker_state(("pieces", path), lambda: PieceTable(path))


def _columns(docs: DataFrame, *names: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.drop(*names).schema)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of any such column.

    A null text counts as empty and has no ids.  Texts are taken whole; repeated rows stay; other
    columns pass through; no rows give no rows.  ``model`` is a path every executor has.
    """
    docs = docs.drop("ids")

    def run(batches):
        table = _table(model)
        for batch in batches:
            for part in row_slices(batch):
                ids = [np.array(table.encode(t.as_py() or ""), np.int32) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, _columns(docs) + "ids array<int>")


def decode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (with ``ids``) with ``decoded`` in place of any such column; null ids give ''."""
    docs = docs.drop("decoded")

    def run(batches):
        table = _table(model)
        for batch in batches:
            for part in row_slices(batch):
                texts = [table.sp.decode(ids.as_py() or []) for ids in part["ids"]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*part.schema.names, "decoded"])

    return docs.mapInArrow(run, _columns(docs) + "decoded string")


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """``decode(encode(docs, model), model)`` in one pass; about a megabyte of text is held at once."""
    docs = docs.drop("ids", "decoded")

    def run(batches):
        table = _table(model)
        for batch in batches:
            for part in row_slices(batch):
                ids, texts = [], []
                for text in part["text"]:
                    found = table.encode(text.as_py() or "")
                    texts.append(table.sp.decode(found))
                    ids.append(np.array(found, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), pa.array(texts, pa.string())],
                                                 [*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, _columns(docs) + "ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass."""
    def run(batches):
        table = _table(model)
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = table.encode(text.as_py() or "")
                out.append((len(ids),
                            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            hashlib.sha256(table.sp.decode(ids).encode()).hexdigest()))
            counts, shas, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
