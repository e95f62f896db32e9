"""Licence recognition by sentences.

A text is read as words (runs of letters and digits, lower case), so that wrapped lines, comment
signs and list bullets do not matter.  Runs of words from the start of a sentence to the end of one
are looked up, by hash, in a table of known sentences; a run may go over line ends but not over a
blank line.  A licence rule is an ordered list of sentence identifiers, met where they follow each
other with at most ``GAP`` words in between (list numbers, names of holders, addresses).
"""
from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.kernel import BLANKS, Texts, Words, byte_table, mix, powers, text_chunks, words

#: Words that may stand between two steps of a rule.
GAP = 16
_OTHER = byte_table([i for i in range(128) if not chr(i).isalnum() and chr(i) != "+"])  # "v3+" is a word
_STOPS, _OPEN, _CLOSE, _LINE = (byte_table(map(ord, s)) for s in (".!?;:", "(", "()", "\r\n"))
#: Letters of other scripts stay; these signs are set apart like their ASCII forms.
_SIGNS = "“”„‘’«»–—•·© ﻿"

# Names of a licence as notices give them.
_VERSIONED = "{0} version {1}|{0} v{1}|{0}v{1}|{0} {1}|{0} v {1}"
_GNU = {"GPL": "gnu general public license|gnu gpl|gpl", "LGPL": "gnu lesser general public license|gnu lgpl|lgpl",
        "AGPL": "gnu affero general public license|gnu agpl|agpl"}
_NAMES = {
    "Apache-2.0": "apache license version 2.0|apache license 2.0|apache license v2.0|apache 2.0 license|apache 2.0|apache 2 license"
                  "|apache-2.0 license|apache software license version 2.0|apache license v2|apache license version 2",
    "MIT": "mit license|mit licence|mit|mit/x11 license|expat license|mit open source license",
    "BSD-2-Clause": "bsd 2-clause license|2-clause bsd license|simplified bsd license|bsd 2-clause simplified license|two-clause bsd license",
    "BSD-3-Clause": "bsd 3-clause license|3-clause bsd license|new bsd license|modified bsd license|revised bsd license"
                    "|bsd 3-clause new or revised license|three-clause bsd license",
    "ISC": "isc license|isc", "Unlicense": "unlicense",
    "MPL-1.1": _VERSIONED.format("mozilla public license", "1.1") + "|mpl 1.1",
    "MPL-2.0": _VERSIONED.format("mozilla public license", "2.0") + "|mpl 2.0|mpl v2.0|mpl-2.0",
    "EPL-1.0": _VERSIONED.format("eclipse public license", "1.0") + "|epl 1.0|epl v1.0",
    "EPL-2.0": _VERSIONED.format("eclipse public license", "2.0") + "|epl 2.0|epl v2.0",
    "CC0-1.0": "cc0 1.0|cc0 1.0 universal|creative commons zero v1.0 universal",
}
for _family, _versions in {"GPL": "2 3", "LGPL": "2.1 3", "AGPL": "3"}.items():
    for _v in _versions.split():
        _plain = "|".join(_VERSIONED.format(n, w) for n in _GNU[_family].split("|")
                          for w in ((_v,) if "." in _v else (_v, f"{_v}.0")))
        _full = _v if "." in _v else f"{_v}.0"
        _NAMES[f"{_family}-{_full}"] = "|".join([*_plain.split("|"), *(f"{n} only" for n in _plain.split("|"))])
        _NAMES[f"{_family}-{_full}-or-later"] = "|".join(
            f"{n} {tail}" for n in _plain.split("|") for tail in (
                "or later", "or any later version", "or at your option any later version", "or newer")
        ) + "|" + "|".join(f"{n}+" for n in _plain.split("|"))
for _code, _words in {"BY": "attribution", "BY-SA": "attribution-sharealike", "BY-NC": "attribution-noncommercial",
                      "BY-ND": "attribution-noderivatives", "BY-NC-SA": "attribution-noncommercial-sharealike",
                      "BY-NC-ND": "attribution-noncommercial-noderivatives"}.items():
    _NAMES[f"CC-{_code}-4.0"] = (f"cc {_code} 4.0|cc {_code} 4.0 license|creative commons {_words} 4.0|creative commons {_words} 4.0 license"
                                 f"|creative commons {_words} 4.0 international license|creative commons {_words} 4.0 international").lower()
_VERBS = "licensed|released|distributed|available|made available|provided|published".split("|")
_TERMS = ("under", "under the terms of", "under the terms and conditions of", "subject to the terms of")


def _notices(name: str, names: str) -> list[str]:
    """Every way to say it in one sentence; a leading ``...`` means that words may come before."""
    return [f"spdx-license-identifier: {name}"] + [
        f"{lead}{verb} {terms} {the}{called}" for called in names.split("|") for verb in _VERBS for terms in _TERMS
        for the in ("", "the ", "an " if called[0] in "aeim" else "a ") for lead in ("", "...is ", "...are ")]


_GRANT = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_FSF = "as published by the free software foundation"


def _gnu(family: str, version: str, later: bool) -> list[str]:
    """The notice of the GNU licences; punctuation between its parts varies, the words do not."""
    tail = f"either version {version} of the license, or (at your option) any later version" if later else f"version {version} of the license"
    return [f"...under the terms of the {name} {_FSF}, {t}" for name in family.split("|")
            for t in ((tail, tail.replace("the license", f"the {name}")) if later else
                      (tail, tail + " only", f"version {version}", f"version {version} only"))]


_LESSER = "gnu lesser general public license|gnu library general public license"
# The sentences of published licence texts and notices, by identifier.
SENTENCES = {
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": ['unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied'],
    "apache-title": ["apache license version 2.0, january 2004"],
    "mit-grant": ['permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions'],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
                   "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ['the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
                  'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and non-infringement'],
    "mit-0-grant": ['permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so'],
    "bsd-redistribution": [_GRANT],
    "bsd-source": [f"{lead}redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
                   for lead in ("", "...")],
    "bsd-binary": [f"{lead}redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
                   for lead in ("", "...")],
    "bsd-names": [f"...may be used to endorse or promote products derived from this software without {w}"
                  for w in ("specific prior written permission", "prior written permission", "specific, prior written permission")],
    "isc-grant": [f"permission to use, copy, modify, {w} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
                  for w in ("and/or", "and")],
    "mpl2-form": ["...source code form is subject to the terms of the mozilla public license, v. 2.0"],
    "mpl2-title": ["mozilla public license version 2.0", "mozilla public license, v. 2.0"],
    "mpl2-definitions": ["...means each individual or legal entity that creates, contributes to the creation of, or owns covered software"],
    "mpl11-contents": ["...contents of this file are subject to the mozilla public license version 1.1"],
    "epl-material": ["...the accompanying materials are made available under the terms of the eclipse public license " + v
                     for v in ("v1.0", "v 1.0", "version 1.0", "v1.0 which accompanies this distribution, and is available at",
                               "v1.0 which accompanies this distribution")],
    "epl2-material": ["...the accompanying materials are made available under the terms of the eclipse public license " + v
                      for v in ("v2.0", "v. 2.0", "version 2.0", "2.0", "v2.0 which accompanies this distribution, and is available at",
                                "v. 2.0 which is available at", "2.0 which is available at", "v2.0 which accompanies this distribution")],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "rights-reserved": ["all rights reserved"],
    **{f"gpl{v}-title": [f"gnu general public license version {v}, {d}"] for v, d in (("1", "february 1989"), ("2", "june 1991"), ("3", "29 june 2007"))},
    "lgpl2-title": ["gnu library general public license version 2, june 1991"],
    "cc0-title": ["cc0 1.0 universal"],
    "agpl3-title": ["gnu affero general public license version 3, 19 november 2007"],
    "lgpl21-title": ["gnu lesser general public license version 2.1, february 1999"],
    "lgpl3-title": ["gnu lesser general public license version 3, 29 june 2007"],
    **{f"{name}-{v}{'+' if later else ''}-terms": _gnu(family, v, later) for name, family, versions in (
        ("gpl", "gnu general public license", "2 3"), ("lgpl", _LESSER, "2 2.1 3"), ("agpl", "gnu affero general public license", "3"))
       for v in versions.split() for later in (True, False)},
    **{f"notice {name}": _notices(name, names) for name, names in _NAMES.items()},
}
# Fixed values: (licence, the sentences that make it up, in order); earlier rules come first.
RULES = [
    ("Apache-2.0", ["notice Apache-2.0", "apache-comply"]),
    ("Apache-2.0", ["notice Apache-2.0"]), ("Apache-2.0", ["apache-title"]),
    ("Apache-2.0", ["apache-comply", "apache-copy", "apache-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT-0", ["mit-0-grant", "mit-as-is"]), ("MIT", ["notice MIT"]),
    # a whole text ends with a notice to copy, so titles come first
    ("AGPL-3.0", ["agpl3-title"]), ("LGPL-2.0", ["lgpl2-title"]), ("LGPL-2.1", ["lgpl21-title"]), ("LGPL-3.0", ["lgpl3-title"]),
    ("GPL-1.0", ["gpl1-title"]), ("GPL-2.0", ["gpl2-title"]), ("GPL-3.0", ["gpl3-title"]),
    *[(f"{name.upper()}-{v if '.' in v else v + '.0'}{'-or-later' if later else ''}", [f"{name}-{v}{'+' if later else ''}-terms"])
      for name, versions in (("agpl", "3"), ("lgpl", "2 2.1 3"), ("gpl", "2 3")) for v in versions.split() for later in (True, False)],
    *[(name, [f"notice {name}"]) for family in ("AGPL", "LGPL", "GPL") for later in (True, False) for name in _NAMES
      if name.startswith(family) and name.endswith("later") == later],
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["notice BSD-3-Clause"]), ("BSD-2-Clause", ["notice BSD-2-Clause"]),
    ("ISC", ["isc-grant"]), ("ISC", ["notice ISC"]),
    ("MPL-2.0", ["mpl2-form"]), ("MPL-2.0", ["mpl2-title", "mpl2-definitions"]), ("MPL-2.0", ["notice MPL-2.0"]),
    ("MPL-1.1", ["mpl11-contents"]), ("MPL-1.1", ["notice MPL-1.1"]),
    ("EPL-2.0", ["epl2-material"]), ("EPL-2.0", ["notice EPL-2.0"]), ("EPL-1.0", ["epl-material"]), ("EPL-1.0", ["notice EPL-1.0"]),
    ("Unlicense", ["unlicense-free"]), ("Unlicense", ["notice Unlicense"]),
    *[(name, [f"notice {name}"]) for name in _NAMES if name.startswith("CC-")],
    ("CC0-1.0", ["cc0-title"]), ("CC0-1.0", ["notice CC0-1.0"]), ("proprietary", ["rights-reserved"]),
]


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SIGNS, " " * len(_SIGNS))


def _runs(found: Words) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
    """A function for the hashes of the runs of ``size`` words at the places ``at``."""
    up, down = powers(len(found.hashes) + 1)
    sums = np.zeros(len(found.hashes) + 1, np.uint64)
    np.cumsum(found.hashes * up[:-1], out=sums[1:])
    return lambda at, size: mix((sums[at + size] - sums[at]) * down[at] + np.asarray(size).astype(np.uint64))


def _edges(texts: Texts, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words a sentence may start at, words it may end at, and the blank lines before each word."""
    n, size = len(found.hashes), len(texts.data)

    def within(table, low, high):  # is a byte of the table in [low, high)
        sums = np.zeros(size + 1, np.int64)
        np.cumsum(table, out=sums[1:])
        return sums[high] - sums[low]

    blank, line = BLANKS[texts.data], _LINE[texts.data]
    stop = np.zeros(size, bool)
    stop[:-1] = _STOPS[texts.data[:-1]] & _OTHER[texts.data[1:]]
    stop[-1:] = True
    firsts, ends = texts.offsets[found.docs], texts.offsets[found.docs + 1]
    inner = np.ones(n, bool)  # the word before is of the same document
    inner[1:] = found.docs[1:] == found.docs[:-1]
    inner[:1] = False
    low = np.where(inner, np.concatenate([[0], found.ends[:-1]])[:n], firsts)
    high = np.concatenate([found.starts[1:], [size]])[:n]
    high = np.where(np.concatenate([inner[1:], [False]])[:n], high, ends)
    start = ~inner | (within(stop | line | _OPEN[texts.data], low, found.starts) > 0)
    end = np.concatenate([~inner[1:], [True]])[:n] | (within(stop | line | _CLOSE[texts.data], found.ends, high) > 0)
    # a blank line: two line breaks with only blanks, or nothing, between them (CR LF is one)
    newline = line & ~((texts.data == 10) & np.concatenate([[False], texts.data[:-1] == 13])[:size])
    breaks = np.flatnonzero(newline)
    solid = np.zeros(size + 1, np.int64)
    np.cumsum(~blank, out=solid[1:])
    empty = np.zeros(size, bool)
    if len(breaks) > 1:
        empty[breaks[1:][solid[breaks[1:]] == solid[breaks[:-1]]]] = True
    return start, end, np.cumsum(within(empty, low, found.starts) > 0)


class Known:
    """The sentences by length: sorted hashes and identifiers, those with words before them apart."""

    def __init__(self, sentences: dict[str, list[str] | str]):
        rows = sorted({(name, s) for name, some in sentences.items() for s in ([some] if isinstance(some, str) else some)})
        forms, heads, shared, at = defaultdict(dict), [], {}, 0
        for chunk in text_chunks(pa.array([s for _, s in rows], pa.string())):
            found = words(chunk, _OTHER)
            low, sizes = found.bounds[:-1], np.diff(found.bounds)
            if not sizes.all():
                raise ValueError(f"a sentence without words: {rows[at + int(np.argmin(sizes))]}")
            for first, size, code in zip(low.tolist(), sizes.tolist(), _runs(found)(low, sizes).tolist()):
                name, text = rows[at]
                some = forms[text.startswith("..."), size]
                names = tuple(dict.fromkeys((*some.get(code, ()), name)))
                some[code] = shared.setdefault(names, names)
                if text.startswith("..."):
                    heads.append(found.hashes[first])
                at += 1
        self.heads = np.unique(np.array(heads, np.uint64))
        self.forms = [(floating, size, np.sort(np.array(list(some), np.uint64)), some)
                      for (floating, size), some in sorted(forms.items())]

    def find(self, texts: Texts) -> dict[int, list[tuple[str, int, int]]]:
        """(sentence, first word, last word) by document; of those that end together the longest."""
        found = words(texts, _OTHER)
        n = len(found.hashes)
        if not n:
            return {}
        start, end, gaps = _edges(texts, found)
        places = (np.flatnonzero(start), np.flatnonzero(np.isin(found.hashes, self.heads)))
        runs, hits = _runs(found), {}
        for floating, size, hashes, names in self.forms:
            at = places[floating]
            at = at[at + size <= n]
            last = at + size - 1
            at = at[end[last] & (found.docs[at] == found.docs[last]) & (gaps[at] == gaps[last])]
            if not len(at):
                continue
            got = runs(at, size)
            same = hashes[np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)] == got
            for a, h in zip(at[same].tolist(), got[same].tolist()):
                doc = int(found.docs[a])
                base = int(found.bounds[doc])
                for name in names[h]:
                    key = (doc, name, a + size - 1 - base)
                    hits[key] = min(a - base, hits.get(key, a - base))
        out = defaultdict(list)
        for (doc, name, last), first in hits.items():
            out[doc].append((name, first, last))
        return out


def _met(hits: list[tuple[str, int, int]], rules: list[tuple[str, list[str]]]) -> list[tuple[str, int, int, int]]:
    """(licence, rule, first, last) for every place where a rule's sentences follow each other."""
    spots = defaultdict(list)
    for name, first, last in hits:
        spots[name].append((first, last))
    for some in spots.values():
        some.sort()
    out = []
    for rule, (license, steps) in enumerate(rules):
        if not all(s in spots for s in steps):
            continue
        for first, last in spots[steps[0]]:
            for step in steps[1:]:
                after = bisect_right(spots[step], (last, 1 << 62))
                if after == len(spots[step]) or spots[step][after][0] - last - 1 > GAP:
                    break
                last = spots[step][after][1]
            else:
                out.append((license, rule, first, last))
    return out


def license_spans(docs: DataFrame, known: dict[str, list[str] | str] | None = None,
                  rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(key, license, rule, first, last): every place where a rule's sentences follow each other.

    ``first`` and ``last`` count words from 0.
    """
    table, rules = Known(known or SENTENCES), rules or RULES

    def run(batches):
        for batch in batches:
            rows = []
            for chunk in text_chunks(batch["text"]):
                for i, hits in table.find(chunk).items():
                    key = batch["key"][chunk.first + i].as_py()
                    rows += [(key, *m) for m in _met(hits, rules)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                                 ["key", "license", "rule", "first", "last"])

    return docs.select("key", _plain(F.col("text")).alias("text")).mapInArrow(
        run, "key string, license string, rule long, first long, last long")


def scan_licenses(docs: DataFrame, **tables) -> DataFrame:
    """(doc_id, n_matches, licenses, license): one row per row of ``docs``.

    ``licenses`` are the distinct names found, sorted; ``license`` is that of the first rule met, by
    rule order, null if there is none.  Null and empty texts have none.  Rows equal in identifier
    and text get equal results; other columns are ignored; no rows give no rows.
    """
    rows = docs.select("doc_id", "text").withColumn("key", F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
        F.coalesce("text", F.lit(""))).cast("binary")))
    found = (license_spans(rows.select("key", "text"), **tables).distinct().groupBy("key")
             .agg(F.count(F.lit(1)).alias("n_matches"),
                  F.sort_array(F.collect_set("license")).alias("licenses"),  # at most the rules' names
                  F.min(F.struct("rule", "license")).alias("top")))
    return rows.select("doc_id", "key").join(found, "key", "left").select(
        "doc_id", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
        F.array_join(F.coalesce("licenses", F.array().cast("array<string>")), ",").alias("licenses"),
        F.col("top.license").alias("license"))
