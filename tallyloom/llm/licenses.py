"""License scan: fixed phrases, and fuzzy search for short notices.

A notice of n characters may differ by n // 10 edits. Cut into one part more than it may have
edits, at least one part stands unchanged in every such copy (pigeonhole), so one pass of an
Aho-Corasick automaton over those parts locates all candidates. Around each, the regex library's
bounded-error matching verifies the edits and gives the span. Parts that tell nearly the same
beginning share a window of little more than the notice's length, so that a text full of notices
takes time in proportion to its length; of matches that overlap the likest holds.

Defined results: a null text is empty; every input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, small_batches, tidy, words

# The contract's phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices looked for with errors, lower case, and what each says.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the apache license, version 2.0": "apache-2",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "creative commons attribution-noncommercial": "cc-by-nc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "this software is provided 'as-is', without any express or implied warranty": "zlib",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "academic free license": "afl",
    "artistic license 2.0": "artistic-2",
    "apache software license": "apache",
    "python software foundation license": "psf",
    "microsoft public license": "ms-pl",
    "sil open font license": "ofl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open data commons open database license": "odbl",
    "creative commons attribution-sharealike": "cc-by-sa",
    "creative commons attribution-noderivatives": "cc-by-nd",
    "creative commons zero v1.0 universal": "cc0",
    "cc0 1.0 universal": "cc0",
    "do what the fuck you want to public license": "wtfpl",
}
CHARS_PER_EDIT = 10
FOLD = str.maketrans(UPPER, LOWER)


def parts(notice: str) -> list[tuple[str, int]]:
    """(part, offset): one more than the edits that a copy may have."""
    n = len(notice) // CHARS_PER_EDIT + 1
    edges = [len(notice) * i // n for i in range(n + 1)]
    return [(notice[i:j], i) for i, j in zip(edges, edges[1:])]


def automaton() -> ahocorasick.Automaton:
    seeds: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for part, at in parts(notice):
            seeds.setdefault(part, []).append((notice, at))
    a = ahocorasick.Automaton()
    for part, where in seeds.items():
        a.add_word(part, (len(part), where))
    a.make_automaton()
    return a


def windows(low: str, seeds: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Stretches of the text that may hold a copy of each notice, its edits' room on either side."""
    starts: dict[str, list[int]] = {}
    for end, (n, where) in seeds.iter(low):
        for notice, at in where:
            starts.setdefault(notice, []).append(end + 1 - n - at)
    found: dict[str, list[tuple[int, int]]] = {}
    for notice, places in starts.items():
        slack, first, last = len(notice) // CHARS_PER_EDIT, None, None
        for start in [*sorted(places), None]:
            if first is not None and (start is None or start - first > 2 * slack):
                found.setdefault(notice, []).append((max(0, first - slack), last + len(notice) + slack))
                first = None
            first, last = start if first is None else first, start
    return found


def fuzzy(low: str, seeds: ahocorasick.Automaton, patterns: dict) -> list[tuple[int, int, str, float]]:
    """(start, end, label, likeness) of each notice in the lower-cased text."""
    found = []
    for notice, spans in windows(low, seeds).items():
        least, matches = len(notice) - len(notice) // CHARS_PER_EDIT, set()
        for i, j in spans:
            # the best of a window first, then what stands on either side of it
            stretches = [(i, j)]
            while stretches:
                i, j = stretches.pop()
                m = patterns[notice].search(low, i, j)
                if m:
                    matches.add((sum(m.fuzzy_counts), m.start(), m.end()))
                    stretches += [(a, b) for a, b in ((i, m.start()), (m.end(), j)) if b - a >= least]
        # windows overlap, matches must not; ends of those that hold, in order
        starts, ends = [], []
        for edits, i, j in sorted(matches):
            at = bisect_right(starts, i)
            if (at == 0 or ends[at - 1] <= i) and (at == len(starts) or j <= starts[at]):
                starts.insert(at, i)
                ends.insert(at, j)
                found.append((i, j, NOTICES[notice], 1 - edits / len(notice)))
    return found


def phrase_places(found: list[str]) -> list[tuple[int, str]]:
    """(word index, label) of each place where a phrase stands."""
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i, w in enumerate(found) if w == p[0] and found[i : i + len(p)] == p]
    return places


def licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is 1 where a phrase stands, else the likeness (1 - edits / length) of the best notice, 0
    without any. spans are label:start:end of the verified notices in code points, by start.
    """
    rare = [sorted(p.split(), key=len)[-1] for p in PHRASES]  # for "cc by nc": any of its words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, word = automaton(), re.compile(WORD)
        patterns = {n: regex.compile(f"(?:{regex.escape(n)}){{e<={len(n) // CHARS_PER_EDIT}}}", regex.BESTMATCH) for n in NOTICES}
        for batch in batches:
            rows = []
            for t in batch.column(2):
                low = (t.as_py() or "").translate(FOLD)
                places = phrase_places(word.findall(low)) if any(w in low for w in rare) else []
                more = fuzzy(low, seeds, patterns)
                at = [i for i, _ in places]
                sure = {x for _, x in places}
                both = sure | {x for _, _, x, _ in more}
                spans = ",".join(f"{x}:{i}:{j}" for i, j, x in sorted({(i, j, x) for i, j, x, _ in more}))
                rows.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(sure)), ",".join(sorted(both)), 1.0 if sure else max((s for *_, s in more), default=0.0), spans))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    small_batches(documents)
    chosen = documents.select(F.col(id_col).alias("doc_id"), F.size(words(F.col(text_col))).cast("bigint").alias("n_words"), F.col(text_col).alias("t"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(run), f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string")
