"""Ranked search, periodic runs and chat formatting against brute force, SQL and round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import SMALL, documents
from tillstar.llm import chat_format, dual_tree, runs


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall(), key=repr)


@pytest.mark.parametrize(
    "query,sql", [(dual_tree.op11_ranked_search, dual_tree.OP11_SQL), (chat_format.op13_chat_format, chat_format.OP13_SQL)]
)
def test_queries_equal_their_sql(spark, query, sql):
    assert sorted((tuple(r) for r in query(spark, SMALL).collect()), key=repr) == duck(sql)


# ---- ranked search ----------------------------------------------------------------------------


def search_truth(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    bags = [(i, b, collections.Counter(b)) for i, b in bags]
    dfs = collections.Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, b, c in bags:
            m = 50 + 50 * len(b) * n_docs // n_words if n_words else 50
            s = 0
            for t in set(terms(text)):
                df, tf = dfs[t], c[t]
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ü1", "é", "x9"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, [1 / (i + 1) for i in range(63)], k=n))
    docs = [(1, None), (2, ""), (3, "?! .."), (4, "W0"), (5, "w0"), (5, "w0"), (None, "w0 w1"), (6, "w5 " * 40_000)]
    docs += [(10 + i, text(rng.randrange(1, 60))) for i in range(150)]
    docs += [(300 + i, docs[20][1]) for i in range(70)]  # many ties
    items = [(0, None), (1, ""), (2, "w0"), (3, "W0 w0 w1."), (4, "nowhere"), (None, "w2 É é"), (7, text(30)), (7, text(30)), (8, docs[20][1])]
    items += [(20 + i, text(rng.randrange(1, 25))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("leaf,blocks", [(16, 4096), (2, 30)])
def test_dual_tree_equals_brute_force(spark, monkeypatch, leaf, blocks):
    monkeypatch.setattr(dual_tree, "ITEMS", blocks)
    docs, items = search_rows()
    left = documents(spark, docs).repartition(3)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = sorted((tuple(r) for r in dual_tree.ranked_search(left, right, k=10).collect()), key=repr)
    assert got == search_truth(docs, items, 10)


def test_search_of_nothing(spark):
    docs, items = search_rows()
    none = spark.createDataFrame([], "item_id long, text string")
    assert dual_tree.ranked_search(documents(spark, docs), none).count() == 0
    some = spark.createDataFrame([(1, "w0")], "item_id long, text string")
    assert dual_tree.ranked_search(documents(spark, []), some).count() == 0


def test_descent_prunes_and_keeps_the_best():
    rng = np.random.default_rng(4)
    n, n_terms, n_items = 2000, 400, 24
    group = rng.integers(0, 40, n)
    owner = np.repeat(np.arange(n), 12)
    term = (group[owner] * 10 + rng.integers(0, 10, len(owner))) % n_terms
    owner, term, tf = dual_tree.counted(owner, term, n_terms)
    value, df = 1000 * tf, np.bincount(term, minlength=n_terms)
    weight = dual_tree.weights(n, df)
    item = np.repeat(np.arange(n_items), 6)
    i_term = (item % 40) * 10 + np.tile(np.arange(6), n_items)
    s = dual_tree.Search(item, i_term, n_items, weight, df, np.zeros(n_items, np.int64), 5)
    for part in np.array_split(np.arange(n), 4):
        mine = np.isin(owner, part)
        s.add(part, owner[mine] - part[0], term[mine], value[mine])
    dense = np.zeros((n_items, n), np.int64)
    for i, t in zip(item, i_term):
        np.add.at(dense[i], owner[term == t], value[term == t] * weight[t])
    got = sorted(s.rows())
    want = sorted((i, int(d), int(dense[i, d])) for i in range(n_items) for d in np.lexsort((np.arange(n), -dense[i]))[:5] if dense[i, d])
    assert got == want
    assert s.opened < n_items * (n / dual_tree.LEAF) * dual_tree.LEAF / 4  # most pairs never came to be scored


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 3])
    assert dual_tree.lengths(n, 10**11, 10**12).tolist() == [50 + 50 * 10**9 * 10**11 // 10**12, 50 + 15]


# ---- periodic runs ----------------------------------------------------------------------------


def runs_truth(w):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {x for s, size, q in found for x in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_transform_multiplies():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 64):
        a, b = rng.integers(0, runs.PRIME, (2, 3, n)).astype(np.uint64)
        got = runs.intt(runs.ntt(a.copy()) * runs.ntt(b.copy()) % np.uint64(runs.PRIME))
        want = [[sum(int(a[r, i]) * int(b[r, (j - i) % n]) for i in range(n)) % runs.PRIME for j in range(n)] for r in range(3)]
        assert got.tolist() == want


def run_texts():
    rng = random.Random(11)
    out = [None, "", " \n", "a", "x " * 11, "x " * 12, "é é " * 6, "ab " * 30_000, " ".join(str(i) for i in range(400)) * 3]
    for _ in range(60):
        n, kind = rng.randrange(1, 170), rng.randrange(5)
        if kind == 0:
            w = rng.choices("ab", k=n)
        elif kind == 1:
            w = (rng.choices("abcd", k=rng.randrange(1, 50)) * n)[:n]
            w[rng.randrange(n)] = "z"
        elif kind == 2:
            a, w = ["a"], ["a", "b"]
            while len(w) < n:
                a, w = w, w + a
        elif kind == 3:
            w = [*"aaaaaaaaaaaaab"] * (n // 14 + 1)
        else:
            w = rng.choices("abc", k=n // 3 + 1) * 3
        out.append(rng.choice([" ", "\t", " \x0b "]).join(w))
    return out


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (5, texts[5])]
    got = runs.periodic_runs(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    for r in got:
        text = texts[20] if r.doc_id is None else texts[r.doc_id]
        w = re.findall(r"[^ \t-\r]+", text or "")
        found = [tuple(x) for x in r.runs]
        want = [(0, 30_000, 1)] if r.doc_id == 7 else runs_truth(w)
        assert found == want and r.n_words == len(w) and r.collapsed == collapsed(w, want)
        assert r.n == "x" and r["a.b"] == "x"
    assert runs.periodic_runs(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.integers(1, 30))
def test_runs_of_small_alphabets(parts, n):
    texts = [" ".join(p) for p in parts] + [" ".join((p * n)[:90]) for p in parts]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    _, found, _, _ = runs.runs_of(data, off)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [runs_truth(t.split()) for t in texts]


def test_chance_zeros_of_the_modulus_fall_apart():
    w = np.array([*[1, 2] * 7, 9, 2, *[1, 2] * 7], np.uint32)
    s, e, d = runs._checked(w, np.array([0]), np.array([30]), np.array([2]))
    assert list(zip(s.tolist(), e.tolist(), d.tolist())) == [(0, 14, 2), (15, 30, 2)]


def test_whole_query_of_runs(spark):
    got = {r.doc_id: tuple(r) for r in runs.op12_periodic_runs(spark, SMALL).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seen = 0
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 700 and h % 10:
            continue  # brute force takes too long
        found = runs_truth(w) if n <= 700 else None
        if found is None:
            seen += got[doc][1] > 0
            continue
        s, size, q = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        assert got[doc] == (doc, len(found), s, size, q, 1000 * size // q if q else None, sha(lines), sha(collapsed(w, found)))
        seen += bool(found)
    assert seen >= 10


# ---- chat formatting --------------------------------------------------------------------------

HARD = ["", "\\", "\\\\", "</turn>", "<\\/turn>", "</turn", "turn>", "### Assistant: x", "\\### Assistant: </turn> ok", "#### ", "<|endoftext|>", "é漢字🙂 \n\n ", ": ", "x:", "​"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "User", "tool: x", "a:", "N", "\\N", "", "### ", None]), st.one_of(st.sampled_from(HARD), st.text(max_size=30), st.lists(st.sampled_from(HARD)).map("".join))), max_size=6))
def test_formatting_is_reversible(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    raw = text.encode()
    assert [chat_format.unescape(raw[a:b].decode()) for _, a, b in spans] == [t for _, t in turns]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, chunk string, part string")


def chat_rows():
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(HARD)]
    rows += [(2, i, "assistant", f"é {i} " * 5) for i in range(700)] + [(3, 0, "user", None), (3, 1, "assistant", None)]
    rows += [(4, None, None, "no role"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "user", "z")]
    rows += [(None, 0, "assistant", "nobody"), (5, 0, "assistant", "long " * 60_000 + " " * 80_000 + "\n" * 70_001), (6, 0, "tool", "t"), (6, 1, "assistant", "\\### Assistant: </turn> ok")]
    return rows


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_chat_round_trip(spark, size):
    rows = chat_rows()
    pieces = chat_format.format_conversations(conversations(spark, rows), chunk_turns=64, piece_chars=size)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(pieces)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted(
            ((turn if turn is not None else -1, role is not None, role or "", hashlib.md5((t or "").encode()).hexdigest(), t or "") for c, turn, role, t in rows if c == conv)
        )
        turns = [(x[2], x[4]) for x in mine]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(chat_format.render([(None if not x[1] else x[2], x[4]) for x in mine])[0])


def test_pieces_do_not_change_tokens(spark):
    rows = [r for r in chat_rows() if r[0] in (1, 2)]
    tokens = []
    for size in (1 << 20, 100):
        got = chat_format.format_conversations(conversations(spark, rows), piece_chars=size).collect()
        by = sorted(got, key=lambda r: (r.conv_id, r.chunk, r.part))
        tokens.append([[t for r in by if r.conv_id == c for t in r.token_ids] for c in (1, 2)])
        assert len(by) > 10 or size > 100
    assert tokens[0] == tokens[1]


def test_masked_tokens_lie_under_their_spans(spark):
    with open(chat_format.TOKENIZER, "rb") as f:
        coder = chat_format.Coder(f.read(), chat_format.PATTERN, ("tool",))
    text, spans = chat_format.render([("user", "Hello there"), ("tool", " 42</turn>"), ("assistant", ""), ("assistant", "Bye é")])
    ids, offsets = coder.encode(text)
    assert coder.decode(ids.tolist()) == text
    runs_ = chat_format.masked(offsets, np.array([(a, b) for _, a, b in spans]))
    assert [coder.decode(ids[a:b].tolist()) for a, b in runs_] == ["Hello there", " 42<\\/turn>", "", "Bye é"]


def test_no_conversations(spark):
    none = conversations(spark, [])
    assert chat_format.digests(chat_format.read_back(chat_format.format_conversations(none))).count() == 0
