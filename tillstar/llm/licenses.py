"""License scans: exact phrases, and fuzzy search for short notices.

Texts are lower-cased (A-Z) and reduced to their words, one space apart. Base phrases are found
exactly. A notice that may differ in up to k edits is split into k + 1 pieces: by the pigeonhole
principle one piece is intact, so exact hits of the pieces (byte search over a slice of many
texts at once) locate every candidate place. Only there the regex library verifies the notice
with at most k insertions, deletions and substitutions, and reports span and edits.

Rows stay where they are: no shuffle, and memory is bounded by the slice (4 MB or one text).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.llm.common import add_columns, table, text_slices

# Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Notice:
    text: str  # words, lower case, one space apart
    label: str
    edits: int


NOTICES = (
    Notice("released under the mit license", "mit-notice", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit-text", 6),
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("this work is licensed under the gnu general public license version 3", "gpl-3.0", 6),
    Notice("this program is free software you can redistribute it and or modify", "gpl-text", 6),
    Notice("licensed under the gnu lesser general public license", "lgpl", 4),
    Notice("licensed under a creative commons attribution", "cc-by-notice", 4),
    Notice("redistribution and use in source and binary forms", "bsd-text", 4),
    Notice("licensed under the mozilla public license", "mpl", 3),
    Notice("all rights reserved", "all-rights-reserved", 1),
)

_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
        T.StructField(
            "found",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("first_word", T.LongType()),
                        T.StructField("last_word", T.LongType()),
                        T.StructField("edits", T.IntegerType()),
                        T.StructField("score", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
_BASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
)
# A-Z to a-z; ASCII other than letters and digits to space; the rest, UTF-8 bytes, are parts of words.
_TO = np.arange(256, dtype=np.uint8)
_TO[65:91] += 32
_TO[:48] = _TO[58:65] = _TO[91:97] = _TO[123:128] = 32


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words of all texts, one space apart, a newline before each text and at the end; word starts; newline places)."""
    b = np.insert(_TO[data], off, 10)
    gap = b == 32
    drop = np.zeros(len(b), bool)
    drop[1:] = gap[1:] & (gap[:-1] | (b[:-1] == 10))
    b = b[~drop]
    starts = np.flatnonzero((b[1:] > 32) & (b[:-1] <= 32)) + 1
    return b.tobytes(), starts, np.flatnonzero(b == 10)


def pieces(notice: Notice) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the edits + 1 parts of a notice."""
    t, k = notice.text.encode(), notice.edits + 1
    cut = [len(t) * i // k for i in range(k + 1)]
    return [(cut[i], t[cut[i] : cut[i + 1]]) for i in range(k)]


def _hits(t: bytes, piece: bytes) -> Iterator[int]:
    at = t.find(piece)
    while at >= 0:
        yield at
        at = t.find(piece, at + 1)


def loose_pattern(notice: Notice) -> regex.Pattern:
    """Best match within the notice's edits, from the start of a word to the end of one."""
    return regex.compile(b"(?b)(?<![^ \n])(?:%s){e<=%d}(?![^ \n])" % (regex.escape(notice.text.encode()), notice.edits))


def fuzzy(t: bytes, lines: np.ndarray, notice: Notice, pattern: regex.Pattern) -> list[tuple[int, int, int]]:
    """(from, to, edits) of a notice's places in ``t``; of overlapping ones the one with fewer edits, then the first.

    Each seed's window is searched by itself, so the work is linear in the seeds. What chosen places
    leave of the windows is searched again, so that a place isn't lost to a better neighbour.
    """
    size, k = len(notice.text.encode()), notice.edits
    windows = set()
    for offset, piece in pieces(notice):
        for at in _hits(t, piece):
            line = int(np.searchsorted(lines, at))
            lo, hi = int(lines[line - 1]) + 1, int(lines[line])
            # one byte more, by which the end of a word is told; no place within the edits ends there
            windows.add((max(lo, at - offset - k), min(hi, at - offset + size + k + 1)))
    starts: list[int] = []  # of chosen places, which are disjoint
    chosen: list[tuple[int, int, int]] = []
    while windows:
        found = set()
        for lo, hi in windows:
            m = pattern.search(t, lo, hi)
            if m:
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        if not found:
            break
        for edits, a, b in sorted(found):
            i = bisect.bisect(starts, a)
            if (i == 0 or chosen[i - 1][1] <= a) and (i == len(starts) or b <= starts[i]):
                starts.insert(i, a)
                chosen.insert(i, (a, b, edits))
        rest = set()
        for lo, hi in windows:
            i = max(0, bisect.bisect(starts, lo) - 1)
            at, cut = lo, False
            while i < len(chosen) and chosen[i][0] < hi:
                a, b, _ = chosen[i]
                if b > lo:
                    cut = True
                    if a - 1 - at >= size - k:  # up to the space before the place
                        rest.add((at, a - 1))
                    at = b + 1
                i += 1
            if cut and hi - at >= size - k:
                rest.add((at, hi))
        windows = rest - windows
    return chosen


def license_frame(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Every row with ``n_words``, ``base`` (label and start of each phrase place) and ``found``
    (label, first and last word, edits and score of each notice place; score is 1 - edits / length).

    Word numbers start at 0. Null texts are empty: no words, empty lists. Input columns of these
    names are replaced, others pass through. Repeated rows are judged alike. Places of different
    notices may overlap; of one notice they don't. Notices begin and end at word borders. Texts of any
    length are searched whole.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "base", "found")]
    if text not in keep:
        raise ValueError("the text column may not be called n_words, base or found")
    body = f"c{keep.index(text)}"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [(regex.compile(rb"(?<![^ \n])" + p.encode() + rb"(?![^ \n])"), p.encode(), label) for p, label in phrases]
        loose = [(n, loose_pattern(n)) for n in notices]
        for batch in batches:
            for i, j, data, off in text_slices(batch, body):
                t, starts, lines = normalise(data, off)
                first = np.searchsorted(starts, lines)  # words before each text
                base: list[list] = [[] for _ in range(j - i)]
                found: list[list] = [[] for _ in range(j - i)]
                for pattern, plain, label in exact:
                    if plain not in t:
                        continue
                    for m in pattern.finditer(t, overlapped=True):
                        d = int(np.searchsorted(lines, m.start(), side="right")) - 1
                        base[d].append({"label": label, "word": int(np.searchsorted(starts, m.start())) - int(first[d])})
                for n, pattern in loose:
                    for lo, hi, edits in fuzzy(t, lines, n, pattern):
                        d = int(np.searchsorted(lines, lo, side="right")) - 1
                        w = int(np.searchsorted(starts, lo, side="right")) - 1 - int(first[d])
                        last = int(np.searchsorted(starts, hi)) - 1 - int(first[d])
                        found[d].append(
                            {"label": n.label, "first_word": max(0, w), "last_word": max(0, last), "edits": edits, "score": max(0.0, 1 - edits / len(n.text))}
                        )
                part = batch.slice(i, j - i)
                columns = list(part.columns)
                columns += [
                    pa.array(np.diff(first)),
                    pa.array([sorted(x, key=lambda p: (p["word"], p["label"])) for x in base], _BASE_TYPE),
                    pa.array(found, _FOUND_TYPE),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "new0", "new1", "new2"])

    return add_columns(docs, keep, list(_SCHEMA.fields), judge)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_frame(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_distinct(F.transform("base", lambda p: p["label"]))
    more = F.transform("found", lambda p: p["label"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda p: p["score"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["word"])).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
