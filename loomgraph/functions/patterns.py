"""What a step-definition regex needs: is it valid, and which literal pieces must a match hold?

Definitions are written in Python's regex dialect, so Python itself vets them and runs the final
match (in Arrow batches); Spark only has to bring the few candidate pairs together.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parser module moved in Python 3.11
    from re import _constants as _sre
    from re import _parser as _sre_parser
except ImportError:  # pragma: no cover
    import sre_constants as _sre
    import sre_parse as _sre_parser

GRAM = 4
# characters of the pieces of long literal runs, and the step between them: whatever GRAM-character piece a
# run has is inside one of them, and numbers of up to seven digits are so with a character on each side
LONG, STEP = 12, 4


def _runs(items, out: list[str]) -> None:
    """Append the literal runs every match must contain; a run never spans an unknown piece."""
    run = ""
    for op, arg in items:
        if op is _sre.LITERAL:
            run += chr(arg)
            continue
        if op is _sre.AT:  # anchors consume nothing
            continue
        out.append(run)
        run = ""
        if op is _sre.SUBPATTERN and not arg[1] and not arg[2]:  # no flags switched inside
            _runs(arg[3], out)
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and arg[0] >= 1:
            _runs(arg[2], out)
    out.append(run)


def literal_runs(expression: str) -> list[str]:
    """The literal runs every matching text contains; empty when unknown."""
    parsed = _sre_parser.parse(expression)
    if parsed.state.flags & re.IGNORECASE:
        return []
    runs: list[str] = []
    _runs(parsed, runs)
    return runs


def required_grams(expression: str) -> list[str]:
    """Distinct ``GRAM``-character pieces every matching text contains; empty when unknown."""
    return sorted({run[i:i + GRAM] for run in literal_runs(expression) for i in range(len(run) - GRAM + 1)})


def required_pieces(expression: str) -> list[str]:
    """The same, but runs of ``LONG`` characters or more are covered by ``LONG``-character pieces.

    Short pieces are shared by ever more texts as a table grows, long ones much less.
    """
    pieces = set()
    for run in literal_runs(expression):
        if len(run) < LONG:
            pieces |= {run[i:i + GRAM] for i in range(len(run) - GRAM + 1)}
        else:
            pieces |= {run[i:i + LONG] for i in (*range(0, len(run) - LONG, STEP), len(run) - LONG)}
    return sorted(pieces)


def vet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` body: add ``reason`` (NULL = valid) and ``grams`` to definition rows."""
    for pdf in batches:
        reasons, grams = [], []
        for expression in pdf["expression"]:
            try:
                if expression is None:
                    raise ValueError("no expression")
                re.compile(expression)
                reasons.append(None)
                grams.append(required_pieces(expression))
            except Exception as err:  # noqa: BLE001 - any failure means: not usable as a pattern
                reasons.append(str(err))
                grams.append([])
        yield pdf.assign(reason=pd.Series(reasons, index=pdf.index, dtype=object),
                         grams=pd.Series(grams, index=pdf.index, dtype=object))


def text_grams(text: Column, length: int = GRAM) -> Column:
    """Distinct pieces of a text of that many characters."""
    size = F.char_length(text)
    starts = F.when(size >= length, F.sequence(F.lit(1), size - (length - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(length))))


def finder(expression: str, anchor: str) -> Callable[[str], re.Match | None]:
    pattern = re.compile(expression)
    return pattern.match if anchor == "start" else pattern.search


def hits(find: Callable[[str], re.Match | None], *texts: str | None) -> bool:
    return any(t is not None and find(t) is not None for t in texts)


def match_pairs(anchor: str, expressions: pd.Series, *texts: pd.Series) -> pd.Series:
    """Row by row: does the expression match one of the texts?  Each one is compiled once."""
    finders = {e: finder(e, anchor) for e in expressions.unique()}
    return pd.Series([hits(finders[e], *row) for e, *row in zip(expressions, *texts)], dtype=bool)
