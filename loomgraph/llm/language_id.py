"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and n-gram bucket are summed inside each partition before the one small
shuffle.  The log-probability matrix is ``buckets`` x languages; its size is fixed by the parameters
(``max_langs`` is checked, never cut), so it may be broadcast.  Scoring is a gather and a segmented
sum in numpy over a chunk of documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.kernel import mix, worker_state

#: Characters a numpy chunk holds (a single longer document makes a larger chunk).
CHUNK_CHARS = 1 << 18
_BLANK = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for text in texts:
        held.append((text or "").lower())
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def gram_buckets(texts: list[str], orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of all the texts, and where each text's buckets begin and end.

    A text is its letters, with one blank for every run of other characters and at both ends.
    """
    table = worker_state("letters", _letters)
    joined = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    letter = table[joined]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes = np.where(letter, joined, _BLANK)[keep].astype(np.uint64)
    # the blank before a text: the last kept blank at or before it
    bounds = np.cumsum(keep)[ends] - 1
    out, where = [], []
    for n in range(1, orders + 1):
        value = np.full(len(codes) - n + 1 if len(codes) >= n else 0, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x1FFFFF) + codes[i:i + len(value)]
        start = np.arange(len(value))
        # grams that begin in one text and end in another are dropped
        doc = np.searchsorted(bounds, start, "right") - 1
        inside = (doc < len(texts)) & (start + n - 1 <= bounds[np.minimum(doc + 1, len(texts))])
        out.append((mix(value) % np.uint64(buckets)).astype(np.int64)[inside])
        where.append(doc[inside])
    doc = np.concatenate(where)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train(rows: DataFrame, orders: int = 4, buckets: int = 1 << 15, max_langs: int = 512):
    """``(langs, log-probability matrix, log priors)`` of the (text, lang) rows given.

    Rows without text, without a letter or without a language teach nothing.
    """
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def flush():
            for lang, row in sums.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)),
                     pa.array(np.append(row[at], docs[lang]))], ["lang", "bucket", "n"])
            sums.clear(), docs.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                if lang is not None and _has_letter(text):
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, chunk in _chunks(texts):
                    got = np.bincount(gram_buckets(chunk, orders, buckets)[0], minlength=buckets)
                    sums[lang] = sums[lang] + got if lang in sums else got
                    docs[lang] = docs.get(lang, 0) + len(chunk)
            if len(sums) > max_langs:
                yield from flush()
        yield from flush()

    counts = (rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # at most max_langs x (buckets + 1) rows reach the driver; one more language is an error
    local = counts.limit(max_langs * (buckets + 1) + 1).toArrow()
    langs = sorted(set(local["lang"].to_pylist()))
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    matrix, priors = np.ones((len(langs), buckets)), np.zeros(len(langs))
    which = np.searchsorted(np.array(langs, object), np.array(local["lang"].to_pylist(), object))
    bucket, n = local["bucket"].to_numpy(), local["n"].to_numpy()
    known = bucket >= 0
    np.add.at(matrix, (which[known], bucket[known]), n[known])
    np.add.at(priors, which[~known], n[~known])
    matrix = np.log(matrix) - np.log(matrix.sum(axis=1, keepdims=True))
    return langs, matrix, np.log(np.maximum(priors, 1)) - np.log(max(priors.sum(), 1))


def identify(docs: DataFrame, training: DataFrame, orders: int = 4, buckets: int = 1 << 15,
             max_langs: int = 512) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the winner's posterior) added, one row per row.

    A null text, or one without any letter, is ``und`` with score 0, as is everything if no row
    teaches.  Ties go to the first language in order.  Columns of those two names are replaced;
    other columns pass through unread.  No rows give no rows.
    """
    docs = docs.drop("lang_pred", "score")
    model = train(training, orders, buckets, max_langs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        langs, matrix, priors = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            pred: list[str] = ["und"] * len(texts)
            score = np.zeros(len(texts))
            usable = [i for i, t in enumerate(texts) if _has_letter(t)] if langs else []
            for first, chunk in _chunks([texts[i] for i in usable]):
                grams, bounds = gram_buckets(chunk, orders, buckets)
                logs = np.stack([np.add.reduceat(row[grams], bounds[:-1]) for row in matrix], 1)
                logs += priors
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i in range(len(chunk)):
                    pred[usable[first + i]] = langs[best[i]]
                    score[usable[first + i]] = share[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()),
                                              pa.array(score)],
                                             [*batch.schema.names, "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{types}, lang_pred string, score double")


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Rows kept from learning: by the checksum of the identifier; a null one teaches."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
