"""Shared helpers of the training-data operators: staging, ranks, word hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.session import scratch_path, tidy_shuffles

#: A word: a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes hashed at a time: its arrays of 8 bytes a byte stay in a core's cache
SEGMENT = 1 << 16

#: of the filter that spares texts which a join would drop (8 MB)
FILTER_BITS = 1 << 26

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: cuts lineage, survives lost executors.
    Its shuffle files go when it is written, so that a chain of stages holds those of one at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with tidy_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no input column can clash with."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def add_columns(df: DataFrame, keep: list[str], new: list[T.StructField], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Columns ``keep`` of a frame and ``new`` ones that ``work`` makes from Arrow batches.

    ``work`` sees kept column i as ``c<i>``, so any column name will do.
    """
    plain = df.select(*quoted(keep)).toDF(*[f"c{i}" for i in range(len(keep))])
    schema = T.StructType(list(plain.schema.fields) + [T.StructField(f"new{i}", f.dataType) for i, f in enumerate(new)])
    return plain.mapInArrow(work, schema).toDF(*keep, *[f.name for f in new])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- vectorised word hashes (inside tasks) ----------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_INV = pow(int(_ODD), -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        m = max(n, (1 << 20) + 1)
        for key, base in (("p", _ODD), ("q", _U(_INV))):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased), and the words' offsets per text (n + 1)."""
    h, at, _ = word_places(data, off)
    return h, np.searchsorted(at, off)


def word_places(
    data: np.ndarray, off: np.ndarray, fold: np.ndarray = _LOWER, is_word: np.ndarray = _IS_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of every word; ``fold`` maps bytes, ``is_word`` tells which bytes words hold.

    Works through segments of ``SEGMENT`` bytes that end between words, so a very long text
    needs 24 bytes a word and no more.
    """
    byte = _BYTE[fold]
    hashes, starts_at, ends_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    inner = off[1:-1]
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        while hi < n:
            cut = np.flatnonzero(~is_word[data[lo:hi]])
            if len(cut):
                hi = lo + int(cut[-1]) + 1
                break
            hi = min(n, hi + SEGMENT)
        b = data[lo:hi]
        w = is_word[b]
        breaks = inner[(inner > lo) & (inner < hi)] - lo
        first = w.copy()
        first[1:] &= ~w[:-1]
        first[breaks] = w[breaks]
        last = w.copy()
        last[:-1] &= ~w[1:]
        last[breaks - 1] = w[breaks - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            p, q = _powers(len(b))
            c = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(np.multiply(byte[b], p[: len(b)], out=c[1:]), out=c[1:])
            hashes.append(mix((c[e] - c[s]) * q[s]))
            starts_at.append(s + lo)
            ends_at.append(e + lo)
        lo = hi
    # a segment may end inside a run of words only at a text's own end, so starts are exact
    return np.concatenate(hashes), np.concatenate(starts_at), np.concatenate(ends_at)


def shingle_table(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, one text after the other, and the texts' offsets (n + 1).

    A shorter text has its whole sequence as its only shingle. A shingle's hash is a sum of its words' hashes,
    each by an odd number of its place, so all texts go in one pass.
    """
    h, at = word_hashes(data, off)
    n = np.diff(at)
    mul = [_U(int(_ODD) * (2 * k + 3) % (1 << 64)) for k in range(size)]
    s = np.full(max(0, len(h) - size + 1), size, dtype=np.uint64)
    for k in range(size):
        s += h[k : len(h) - size + 1 + k] * mul[k]
    s = mix(s)
    parts = []
    for i, a in enumerate(at[:-1].tolist()):
        m = int(n[i])
        if m >= size:
            own = s[a : a + m - size + 1]
            own.sort()  # in place: no two texts have a shingle's start in common
        elif m:
            own = np.full(1, m, dtype=np.uint64)
            for k in range(m):
                own += h[a + k : a + k + 1] * mul[k]
            own = mix(own)
        else:
            own = s[:0]
        parts.append(own)
    sizes = np.array([len(x) for x in parts])
    flat = np.concatenate([*parts, s[:0]])
    ends = np.cumsum(sizes)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[np.append(0, ends)]


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """``shingle_table`` as a list of sets."""
    flat, at = shingle_table(data, off, size)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes: (from, to, bytes, offsets)."""
    data, off = utf8(batch.column(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def packed(docs: DataFrame, keep: list[str], text: str = "text", level: int = 5, wanted: DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` and ``body``: the text as a Zstandard frame, which halves what a shuffle of texts writes.

    With ``wanted``, a frame of one column, rows whose first kept column cannot be in it are left out, by a
    filter of ``FILTER_BITS`` bits that every task gets: some rows that are not in it stay, none that is goes.
    """
    shared, names = None, [*keep, text]
    if wanted is not None:
        other, at = wanted.columns[0], fresh("at")
        kind = docs.schema[keep[0]].dataType
        hashed = wanted.select(F.xxhash64(F.col(other).cast(kind)).bitwiseAND(FILTER_BITS - 1).alias("h"))
        words = hashed.groupBy(F.shiftright("h", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 AS int)))").alias("bits")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, np.uint64)  # of at most as many words
        bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast(bits)
        docs = docs.withColumn(at, F.xxhash64(keep[0]).bitwiseAND(FILTER_BITS - 1))
        names.append(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            if shared is not None:
                h = batch.column(batch.num_columns - 1).to_numpy()
                batch = batch.filter(pa.array(shared.value[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1) == 1))
            body = [press.compress(b"" if not x.is_valid else x.as_buffer()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(body, pa.binary())], [*keep, "body"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("body", T.BinaryType())])
    return docs.select(*names).mapInArrow(run, schema)


def unpacked(body: pa.Scalar) -> bytes:
    return zstandard.decompress(body.as_py())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- distributed ranks ------------------------------------------------------------------------


def spread(key: Column, cells: int = 4096) -> Column:
    """Cell of a 32-digit hex key, in key order: equal shares, whatever the data."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32)).cast("int")


# ---- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable. Alternating large-star and small-star rounds.

    Each round's edges are written to the shared folder. Nodes without edges are not returned.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct()
    )
    e = stage(e, "cc")
    last = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").filter("u <> v")
        e = stage(small.unionByName(low.selectExpr("u", "m AS v")).distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))


# ---- groups and blocks ------------------------------------------------------------------------


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType | str, tasks: int | None = None) -> DataFrame:
    """Rows of equal ``keys`` come to one task, sorted, and ``work`` gets each group as a table.

    For many small groups this is far cheaper than one Python call per group through Spark.
    Groups must be of bounded size; ``in_blocks`` sees to that. ``tasks`` is how many tasks share
    them, where the session's count of shuffle partitions does not follow the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for k in keys:
                c = batch.column(k)
                if batch.num_rows > 1:
                    new[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if held and not same:
                yield from work(pa.Table.from_batches(held))
                held = []
            ends = [*at[1:], batch.num_rows]
            for lo, hi in zip(at, ends):
                held.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    yield from work(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt = df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def map_many_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType | str, rows: int = 2048) -> DataFrame:
    """As ``map_groups``, but ``work`` gets tables of many whole groups, of about ``rows`` rows, and each
    row's group number: for groups so small that a call for each costs more than its rows."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[0] = True
        for k in keys:
            c = t[k].combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                held.append(batch.slice(lo, rows))
                if sum(b.num_rows for b in held) <= rows:
                    continue
                t = pa.Table.from_batches(held)
                new = starts(t)
                cut = int(np.flatnonzero(new)[-1])  # the last group may go on
                if cut:
                    yield from work(t.slice(0, cut), np.cumsum(new[:cut]) - 1)
                    held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from work(t, np.cumsum(starts(t)) - 1)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def in_blocks(members: DataFrame, keys: list[str], node: str, chunk: int, weight: Column | None = None, heavy: int = 0, salts: int = 1) -> DataFrame:
    """Adds ``bi`` and ``bj``: group members are dealt to chunks of about ``chunk`` rows by a hash of
    ``node``, and every pair of chunks of a group (bi <= bj) is a block of its own, so that all pairs
    of a group meet in blocks of bounded size however large the group. Groups of one row go.

    With ``weight`` a chunk also holds about ``heavy`` of it at most (but for a row that weighs more
    by itself). Members meet their group's size in ``salts`` parts, so a large group is not one key.
    """
    total = F.lit(0) if weight is None else F.sum(weight)
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), total.alias("_weight")).filter("_size > 1")
    chunks = F.ceil(F.col("_size") / chunk) if weight is None else F.greatest(F.ceil(F.col("_size") / chunk), F.ceil(F.col("_weight") / heavy))
    names = {k: fresh(k) for k in keys}
    part = fresh("part")
    sizes = sizes.select(*keys, chunks.cast("int").alias("_k")).withColumnsRenamed(names)
    on = [F.col(k) == F.col(n) for k, n in names.items()]
    if salts > 1:
        sizes = sizes.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append(F.pmod(F.xxhash64(F.lit(7), node), F.lit(salts)).cast("int") == F.col(part))
    out = members.join(sizes, on).drop(*names.values(), part)
    out = out.withColumn("_c", F.pmod(F.xxhash64(node), F.col("_k")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    out = out.withColumn("bi", F.least("_c", "_o")).withColumn("bj", F.greatest("_c", "_o")).withColumn("own", F.col("_c"))
    return out.drop("_k", "_c", "_o")


class Forest:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
