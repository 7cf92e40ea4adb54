"""Ranked lexical search by a dual-tree descent over items and documents.

1. Vectors. Each document is tokenised once and keeps its count of terms n and, of the terms that
   any item has, (term, count). A second pass over these vectors sums N, L and the df of each term.
2. Trees. A task reads the vectors block by block. It orders a block's documents by the term that
   counts most in them and builds a hierarchy over them; a node holds, per term, the maximum of
   the term's saturated count over its documents. Items, ordered by their commonest term, have a
   hierarchy of their own, whose nodes hold the maximum weight per term.
3. Descent. For a pair of an item node and a document node, the sum of products of the maxima
   bounds every score below it. A pair whose bound is under the smallest kth score of the node's
   items goes, with all items and documents below it; the others are opened, level by level, and
   what is left of (item, leaf) pairs is scored. A task's kth scores rise as it reads on.
4. Floors. A first descent over a sixteenth of the documents gives every item a kth score that
   the whole result cannot be under; all tasks of the descent over all documents start there.
5. Every task sends at most k rows an item; a rank with a map-side limit merges them.

Pruned pairs are strictly under a score that k documents reach, so ties are kept and the result is
exact. Items travel in blocks of bounded size (``ITEMS`` rows, ``TERMS`` terms but for an item that
has more by itself), one descent a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstar.llm.common import _LOWER, stage, table, text_slices, word_places

TOP = 50
ITEMS = 4096
TERMS = 1 << 18
LEAF, FAN = 16, 16
ITEM_FAN = 8
#: Entries of a join of vectors with item lists that are worked on at once.
STEP = 1 << 21

# The bytes of terms (ASCII letters and digits, and all bytes beyond ASCII).
_IS_TERM = np.zeros(256, bool)
_IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every term (A-Z lower-cased), and the terms' offsets per text (n + 1)."""
    h, at, _ = word_places(data, off, fold=_LOWER, is_word=_IS_TERM)
    return h, np.searchsorted(at, off)


def counted(owner: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, count) of distinct pairs, by owner, then term."""
    pair, count = np.unique(owner.astype(np.int64) * n_terms + term, return_counts=True)
    return pair // n_terms, pair % n_terms, count


@dataclass
class Tree:
    """Levels from the root down; a level lists (node, term, maximum) entries, its nodes' parents and their number.

    ``order`` has the members by place; members are the lowest level.
    """

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    parents: list[np.ndarray]
    order: np.ndarray

    def size(self, i: int) -> int:
        return len(self.parents[i])


def tree(owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, key: np.ndarray, fans: tuple[int, ...]) -> Tree:
    """Hierarchy over 0..n-1 in the order of ``key``: members, then nodes of ``fans`` children, then one root."""
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    n_terms = int(term.max(initial=0)) + 1
    node, size = place[owner], n
    by = np.lexsort((term, node))
    levels, parents = [(node[by], term[by], value[by])], []
    for fan in (*fans, max(1, n)):
        up = np.arange(size) // fan
        parents.append(up)
        node, t, v = levels[-1]
        pair = up[node] * n_terms + t if len(node) else node
        by = np.argsort(pair, kind="stable")
        pair, v = pair[by], v[by]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        levels.append((pair[first] // n_terms, pair[first] % n_terms, np.maximum.reduceat(v, first) if len(first) else v))
        size = int(up[-1]) + 1 if size else 0
    parents.append(np.zeros(size, np.int64))
    return Tree(levels[::-1], parents[::-1], order)


def products(items: tuple, docs: tuple, n_items: int, n_docs: int, n_terms: int, open_: np.ndarray | None = None) -> np.ndarray:
    """Sums of products over common terms, an (item node, document node) matrix; pairs not ``open_`` stay 0."""
    i_node, i_term, i_value = items
    by = np.argsort(i_term, kind="stable")
    i_node, i_term, i_value = i_node[by], i_term[by], i_value[by]
    start = np.searchsorted(i_term, np.arange(n_terms + 1))
    d_node, d_term, d_value = docs
    if open_ is not None:
        some = open_.any(axis=0)[d_node]
        d_node, d_term, d_value = d_node[some], d_term[some], d_value[some]
    count = (start[1:] - start[:-1])[d_term]
    out = np.zeros(n_items * n_docs, np.int64)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + STEP, side="right")))
        c = count[lo:hi]
        at = np.repeat(start[d_term[lo:hi]] - (ends[lo:hi] - c - base), c) + np.arange(int(c.sum()))
        pair = i_node[at] * n_docs + np.repeat(d_node[lo:hi], c)
        value = i_value[at] * np.repeat(d_value[lo:hi], c)
        if open_ is not None:
            live = open_.ravel()[pair]
            pair, value = pair[live], value[live]
        np.add.at(out, pair, value)
        lo = hi
    return out.reshape(n_items, n_docs)


class Search:
    """The items of a block, their tree, and the best documents a task has met so far."""

    def __init__(self, item: np.ndarray, term: np.ndarray, n_items: int, weight: np.ndarray, df: np.ndarray, floor: np.ndarray, k: int):
        self.k, self.n, self.n_terms = k, n_items, len(weight)
        common = np.zeros(n_items, np.int64)
        by = np.lexsort((df[term], item))
        common[item[by]] = term[by]  # the last one, with the largest df, stays
        self.tree = tree(item, term, weight[term], n_items, common, (ITEM_FAN,))
        self.floor = floor[self.tree.order]
        none = np.zeros(0, np.int64)
        self.best = [(none, none) for _ in range(n_items)]  # (score, id) by place
        self.kth = np.maximum(self.floor, 1)
        self.opened = self.pairs = 0

    def limits(self, level: int) -> np.ndarray:
        """Weakest kth score under each node of a level."""
        low, at = self.kth, len(self.tree.levels) - 1
        while at > level:
            up = self.tree.parents[at]
            out = np.full(self.tree.size(at - 1), np.iinfo(np.int64).max)
            np.minimum.at(out, up, low)
            low, at = out, at - 1
        return low

    def add(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """One block of documents: their ids, and entries (document, term, saturated count)."""
        n = len(ids)
        if not n or not len(owner):
            return
        worth = value * self.weight_of(term)
        top = np.full(n, -1, np.int64)
        by = np.lexsort((worth, owner))
        top[owner[by]] = term[by]
        docs = tree(owner, term, value, n, top, (LEAF, FAN))
        ids = ids[docs.order]
        # roots, then item groups with document groups, with leaves, and items with leaves
        open_ = np.ones((1, 1), bool)
        i = j = 0
        for i_next, j_next in ((0, 0), (1, 1), (1, 2), (2, 2), (2, 3)):
            if i_next > i:
                open_ = open_[self.tree.parents[i_next]]
            if j_next > j:
                open_ = open_[:, docs.parents[j_next]]
            i, j = i_next, j_next
            bound = products(self.tree.levels[i], docs.levels[j], self.tree.size(i), docs.size(j), self.n_terms, open_)
            open_ &= bound >= self.limits(i)[:, None]
            if not open_.any():
                return
        self.opened += int(open_.sum())
        for x in np.flatnonzero(open_.any(axis=1)):
            at = np.flatnonzero(open_[x])
            score = np.concatenate([self.best[x][0], bound[x, at]])
            who = np.concatenate([self.best[x][1], ids[at]])
            by = np.lexsort((who, -score))[: self.k]
            self.best[x] = (score[by], who[by])
            if len(by) == self.k:
                self.kth[x] = max(self.kth[x], score[by[-1]])

    def weight_of(self, term: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_weights"):
            self._weights = np.zeros(self.n_terms, np.int64)
            _, t, w = self.tree.levels[-1]
            self._weights[t] = w
        return self._weights[term]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for x, (score, who) in enumerate(self.best):
            for s, d in zip(score.tolist(), who.tolist()):
                yield int(self.tree.order[x]), d, s


NULL_ID = np.iinfo(np.int64).max


def vectors(docs: DataFrame, vocabulary, text: str = "text") -> DataFrame:
    """(doc_id, n, term, tf): a document's number of terms, and its counts of the vocabulary's terms by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for i, j, data, off in text_slices(batch, "body"):
                h, at = terms_of(data, off)
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                d, t, c = counted(owner[hit], place[hit], len(known))
                lists = pa.array(np.searchsorted(d, np.arange(len(n) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(lists, pa.array(t.astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(c.astype(np.int32))),
                    ],
                    ["doc_id", "n", "term", "tf"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("body"))
    return plain.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def document_counts(vecs: DataFrame, n_terms: int) -> DataFrame:
    """(term, df), summed in every task before it leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch, "term"), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    return vecs.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64).reshape(-1)


def lengths(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L, also where the product has more than 64 bits."""
    if len(n) and int(n.max()) * n_docs * 50 >= 1 << 62:
        return np.array([50 + 50 * x * n_docs // n_words for x in n.tolist()], np.int64)
    return 50 + 50 * n * n_docs // max(1, n_words)


def descend(vecs: DataFrame, items, n_items: int, stats: dict, floor: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every task that are not under the floors. Null ids come last among ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term = items.value
        search = Search(item, term, n_items, stats["weight"], stats["df"], floor, k)
        for batch in batches:
            ids = batch.column("doc_id")
            ids = ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            count = batch.column("term").value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), count)
            t, tf = flat(batch, "term"), flat(batch, "tf")
            m = lengths(n, stats["N"], stats["L"])
            value = 1_000_000_000 * tf // (1000 * tf + 20 * m[owner])
            search.add(ids, owner, t, value)
        out = list(search.rows())
        if out:
            i, d, s = (np.array(x, np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(d, mask=d == NULL_ID), pa.array(s)], ["item", "doc_id", "score"])

    return vecs.mapInArrow(run, "item int, doc_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def item_blocks(items: DataFrame, text: str) -> DataFrame:
    """(block, item_id, terms): rows of items with their distinct terms, dealt to blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, "body"):
                h, at = terms_of(data, off)
                lists = [np.unique(h[at[x] : at[x + 1]]).view(np.int64) for x in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, j - i), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "terms"])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(text).alias("body"))
    rows = stage(plain.mapInArrow(run, "item_id long, terms array<long>").filter(F.size("terms") > 0), "search-items")
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // (ITEMS // 2)), -(-words // (TERMS // 2)))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)).cast("int")), blocks


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0.

    Null and empty texts have no terms: such documents are not counted in N, such items find
    nothing. Rows that repeat are documents (items) of their own; equal scores come by doc_id,
    null last. Items that share an item_id have a list each. Very long texts are read whole; a
    document's vector has at most as many entries as the items have terms. Terms are compared by
    64-bit hashes. Other columns are ignored. Without items, documents or common terms the result
    is empty.
    """
    spark = docs.sparkSession
    queries, blocks = item_blocks(items, text)
    out = None
    for b in range(blocks):
        rows = queries.filter(F.col("block") == b).select("item_id", "terms").collect()  # a block, bounded
        if not rows:
            continue
        hashes = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        known, term = np.unique(np.concatenate(hashes), return_inverse=True)
        item = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
        vecs = stage(vectors(docs, spark.sparkContext.broadcast(known), text), "search-vectors")
        n_docs, n_words = vecs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for r in document_counts(vecs, len(known)).collect():  # at most a row per term of the block
            df[r["term"]] = r["df"]
        stats = {"N": n_docs, "L": n_words, "df": df, "weight": weights(n_docs, df)}
        sent = spark.sparkContext.broadcast((item, term))
        floor = np.zeros(len(rows), np.int64)
        some = vecs.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(16)) == 0)
        for r in best(descend(some, sent, len(rows), stats, floor, k), k).filter(F.col("rank") == k).select("item", "score").collect():
            floor[r["item"]] = r["score"]  # one number an item
        found = best(descend(vecs, sent, len(rows), stats, floor, k), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        found = stage(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-found")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS t FROM documents),
q AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}')) AS t FROM benchmark),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, coalesce(sum(len(t)), 0)::BIGINT AS n_words FROM d),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(t)::BIGINT * n_docs) // n_words) AS m FROM d, s WHERE len(t) > 0),
qt AS (SELECT i, item_id, unnest(t) AS term FROM q),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
p AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
