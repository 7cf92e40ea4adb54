"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch with smallest period q and at least max(12, 2 q) words that neither neighbour
extends. At scale k, for periods q in [2^k, 2^(k+1)), the words are cut into aligned blocks of
B = 2^(k-1) words (a few more at the smallest scales), so that the first q words or more of any
run hold a whole block, and that block occurs again q words later. For every block an exact
number-theoretic transform gives, at all distances of the scale at once, the sum of squared
differences between the block and the window that follows; a zero is an occurrence. Distances
with zeros in consecutive blocks are one stretch, which is extended on both sides by less than a
block; extended stretches that are long enough are runs.

What cannot matter is left out before the transform, and nothing else: blocks with a word that
has no further occurrence within the scale's longest distance, and blocks that lie with their
window inside a run of smaller period. A stretch inside a run whose period divides its distance
has that run's period and is no run of its own.

The sums are taken modulo a prime, so a zero of the true sum is always found; runs are compared
word by word at the end. Many texts are worked on at once, laid out one after another with a
separator of its own between any two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.llm.common import WORD, add_columns, fresh, table, text_slices, word_places

MIN_LENGTH = 12
#: 15 * 2^27 + 1, with primitive root 31: transforms of up to 2^27 points.
PRIME = 2013265921
_P = np.uint64(PRIME)
_ROOT = 31
#: Points that one call transforms, for a few MB of memory whatever the text.
POINTS = 1 << 17
_AS_IS = np.arange(256, dtype=np.uint8)
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _less(x: np.ndarray) -> np.ndarray:
    """x mod the prime, for x below twice the prime."""
    return np.minimum(x, x - _P)


def _roots(half: int, inverse: bool) -> np.ndarray:
    if (half, inverse) not in _ROOTS:
        w = pow(_ROOT, (PRIME - 1) // (2 * half), PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        out = np.ones(half, np.uint64)
        filled = 1
        while filled < half:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(w, filled, PRIME)) % _P
            filled *= 2
        _ROOTS[half, inverse] = out
    return _ROOTS[half, inverse]


def ntt(a: np.ndarray) -> np.ndarray:
    """Transform of every row (a power of two points), in bit-reversed order; ``a`` is used up."""
    m, n = a.shape
    half = n // 2
    while half:
        v = a.reshape(m, n // (2 * half), 2, half)
        s, d = _less(v[:, :, 0] + v[:, :, 1]), _less(v[:, :, 0] + _P - v[:, :, 1])
        v[:, :, 0] = s
        v[:, :, 1] = d * _roots(half, False) % _P
        half //= 2
    return a


def intt(a: np.ndarray) -> np.ndarray:
    """Inverse of ``ntt``."""
    m, n = a.shape
    half = 1
    while half < n:
        v = a.reshape(m, n // (2 * half), 2, half)
        t = v[:, :, 1] * _roots(half, True) % _P
        s, d = _less(v[:, :, 0] + t), _less(v[:, :, 0] + _P - t)
        v[:, :, 0] = s
        v[:, :, 1] = d
        half *= 2
    return a * np.uint64(pow(n, -1, PRIME)) % _P


def block_size(k: int) -> int:
    """Words of a block at scale k: the longest for which every run's repeated part holds an aligned one."""
    low = 1 << k
    room = min(max(MIN_LENGTH, 2 * q) - q for q in range(low, 2 * low)) if low < MIN_LENGTH else low
    return max(1, min((room + 1) // 2, 4 if low < 4 else low // 2 + (low == 4)))


def zero_distances(w: np.ndarray, ends: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of all occurrences of the blocks at ``at`` at distances 2^k to 2^(k+1) - 1."""
    low = 1 << k
    window = low + size - 1
    points = 1 << (window - 1).bit_length()
    rows = max(1, POINTS // points)
    found_at, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    inner, outer = np.arange(size), low + np.arange(window)
    for lo in range(0, len(at), rows):
        p = at[lo : lo + rows]
        block = w[p[:, None] + inner].astype(np.uint64)
        follow = w[np.minimum(p[:, None] + outer, len(w) - 1)].astype(np.uint64)
        a = np.zeros((len(p), points), np.uint64)
        a[:, :size] = block[:, ::-1]
        b = np.zeros((len(p), points), np.uint64)
        b[:, :window] = follow
        cross = intt(ntt(a) * ntt(b) % _P)[:, size - 1 : size - 1 + low]
        own = (block * block % _P).sum(axis=1, keepdims=True) % _P
        total = np.zeros((len(p), window + 1), np.uint64)
        np.cumsum(follow * follow % _P, axis=1, out=total[:, 1:])
        other = (total[:, size:] - total[:, :low]) % _P
        zero = (own + other) % _P == 2 * cross % _P
        zero &= np.arange(low) <= (ends[lo : lo + rows] - p - size - low)[:, None]
        i, d = np.nonzero(zero)
        found_at.append(p[i])
        found_d.append(d + low)
    return np.concatenate(found_at), np.concatenate(found_d)


def _extended(w: np.ndarray, at: np.ndarray, d: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, going by ``step``, equal the word ``d`` later; ``most`` at most."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, (1 << 18) // most)
    go = step * np.arange(most)
    for lo in range(0, len(at), rows):
        x = at[lo : lo + rows, None] + go
        y = x + d[lo : lo + rows, None]
        inside = (x >= 0) & (y < len(w))
        same = inside & (w[np.where(inside, x, 0)] == w[np.where(inside, y, 0)])
        out[lo : lo + rows] = np.where(same.all(axis=1), most, np.argmin(same, axis=1))
    return out


def find_runs(w: np.ndarray, ends: np.ndarray, near: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts laid out in ``w``.

    ``ends`` has the end of the text at each place, ``near`` the distance to the next equal word
    (large: none); a separator that equals nothing else follows each text.
    """
    none = np.zeros(0, np.int64)
    start, end, period = none, none, none
    k = 0
    while 2 << k <= longest:  # shortest run of the scale
        low, high, size = 1 << k, (2 << k) - 1, block_size(k)
        n = len(w) // size
        good = near[: n * size].reshape(n, size).max(axis=1) <= high
        if len(start):
            inner = period <= size
            s, e = start[inner], end[inner]
            to = np.where(e == ends[s], (e - size) // size, (e - high - size) // size) + 1
            first = -(-s // size)
            some = to > first
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, first[some], 1)
            np.add.at(mark, np.minimum(to[some], n), -1)
            good &= np.cumsum(mark[:n]) == 0
        at = np.flatnonzero(good) * size
        at = at[at + low + size <= ends[at]]
        p, d = zero_distances(w, ends[at], at, k, size)
        if len(p):
            order = np.lexsort((p, d))
            p, d = p[order], d[order]
            head = np.ones(len(p), bool)
            head[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + size)
            tail = np.append(head[1:], True)
            a, b, d = p[head], p[tail] + size, d[head]
            order = np.argsort(a, kind="stable")
            a, b, d = a[order], b[order], d[order]
            free = np.ones(len(a), bool)
            lo, hi = np.searchsorted(a, start), np.searchsorted(a, end)
            for i in np.flatnonzero(hi > lo):
                part = slice(lo[i], hi[i])
                free[part] &= (d[part] % period[i] != 0) | (a[part] + d[part] + size > end[i])
            a, b, d = a[free], b[free], d[free]
            s = a - _extended(w, a - 1, d, -1, size)
            e = b + _extended(w, b, d, 1, size) + d
            long = e - s >= np.maximum(MIN_LENGTH, 2 * d)
            s, e, d = _checked(w, s[long], e[long], d[long])
            start, end, period = np.concatenate([start, s]), np.concatenate([end, e]), np.concatenate([period, d])
        k += 1
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _checked(w: np.ndarray, s: np.ndarray, e: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches compared word by word; one that a chance zero of the modulus joined falls apart."""
    out = []
    for x, y, q in zip(s.tolist(), e.tolist(), d.tolist()):
        same = w[x : y - q] == w[x + q : y]
        if same.all():
            out.append((x, y, q))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        out += [(x + i, x + j + q, q) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()) if j - i + q >= max(MIN_LENGTH, 2 * q)]
    got = np.array(out, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def runs_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of texts (bytes and offsets): words per text, runs per text (start, length, period a row, by start, then
    period), and the bytes and offsets of the collapsed texts: kept words joined by one space."""
    h, first, last = word_places(data, off, fold=_AS_IS)
    n_docs = len(off) - 1
    at = np.searchsorted(first, off)
    n = np.diff(at)
    size = len(h) + n_docs
    # layout: the words of a text, then its separator
    doc = np.repeat(np.arange(n_docs), n)
    place = np.arange(len(h)) + doc
    base = at[:-1] + np.arange(n_docs)
    w = np.zeros(size, np.uint32)
    near = np.full(size, np.iinfo(np.int32).max, np.int32)
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_at = h[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    w[sorted_at] = np.cumsum(new)
    gap = np.diff(sorted_at)
    near[sorted_at[:-1][~new[1:]]] = gap[~new[1:]]
    w[base + n] = int(new.sum()) + 1 + np.arange(n_docs)
    ends = np.repeat(base + n, n + 1)
    start, end, period = find_runs(w, ends, near, int(n.max(initial=0)))

    drop = np.zeros(size + 1, np.int32)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    keep = (np.cumsum(drop[:size]) == 0)[place]
    of = np.searchsorted(base, start, side="right") - 1
    table_ = np.stack([start - base[of], end - start, period], axis=1)
    runs = np.split(table_, np.searchsorted(of, np.arange(1, n_docs)))

    # a kept word takes the byte after it along as its space, but for the last one of a text
    s, e, own = first[keep], last[keep], doc[keep]
    more = np.append(own[1:] == own[:-1], False) if len(own) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 2, np.int8)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + more, -1)
    inside = np.cumsum(edge[: len(data)], dtype=np.int8).view(bool)
    text = data.copy()
    text[e[more]] = 32
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=kept[1:])
    return n, runs, text[inside], kept[off]


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, and n_words, ``runs`` (by start, then period) and ``collapsed``.

    Words are runs of anything but space and tab to carriage return, compared as written (by
    64-bit hashes). ``collapsed`` joins by one space all words but those that any run holds after
    its first period. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Every row is judged by itself, so repeated rows give equal rows and ties cannot arise. A very
    long text is worked on whole, with some 60 bytes a word. Input columns named n_words, runs or
    collapsed are replaced; other columns pass through. No rows in, no rows out.
    """
    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]
    keep = [c for c in docs.columns if c != text and c.lower() not in ("n_words", "runs", "collapsed")]
    body = f"c{len(keep)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, body):
                n, runs, out, cut = runs_of(data, off)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                item = pa.StructArray.from_arrays([pa.array(flat[:, x]) for x in range(3)], ["start", "length", "period"])
                at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), item)
                texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out)))
                new = [pa.array(n.astype(np.int64)), lists, texts.cast(pa.string())]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *new], [*part.schema.names, "new0", "new1", "new2"]
                )

    return add_columns(docs, [*keep, text], made, work).drop(text)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's own repeats: in one of ten texts the words from a place on repeat the p words there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    turns = F.ceil((n - a) / p).cast("int")
    whole = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), F.least(p, n - a).cast("int")), turns))
    out = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(whole, F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & (n > 0), out).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    top = fresh("top")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn(top, best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col(top)["start"]).alias("start"),
        F.col(top)["length"].alias("length"),
        (-F.col(top)["period"]).alias("period"),
        F.expr(f"(1000 * {top}.length) div (-{top}.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
