"""The prefix trie, the exact search and the filter audit against brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import exact_search, filter_audit, prefix_trie

RNG = np.random.default_rng(11)


# ---- trie


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuilt(rows):
    """{conv_id: [(role, text), ...]} by the rule of the operator."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(sequences):
    """The rows of the trie, by whole prefixes."""
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below = lambda v: [u for u in members if u[: len(v)] == v]
    out = []
    for v, cs in members.items():
        children = [u for u in members if len(u) == len(v) + 1 and u[:-1] == v]
        subtree = below(v)
        leaves = [u for u in subtree if not any(len(w) == len(u) + 1 and w[:-1] == u for w in subtree)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in subtree if u)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(sequences[c]) == len(v)))
        out.append((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    turns = [("user", "a"), ("user", "b ß"), ("assistant", ""), (None, None), ("system", "long " * 5000), (None, "a")]
    rows = []
    for c in [*range(60), -3, -11, 10**15]:
        rows += [(c, t, *turns[RNG.integers(0, 2 + c % 5)]) for t in range(int(RNG.integers(1, 14)))]
    rows += [(c, t, "user", "same") for c in range(100, 190) for t in range(3)]  # a hot group of copies
    rows += [rows[5], (7, None, "user", "first"), (7, None, "user", "also first"), (None, 0, "user", "nobody's")]
    return rows


@pytest.fixture(scope="module")
def chats(spark):
    rows = conversations()
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, p int").repartition(3)


@pytest.mark.parametrize("run,tasks", [(1 << 18, None), (25, 9), (1, 40)])
def test_trie_equals_brute_force(chats, run, tasks):
    """Many small runs and tasks put many borders inside copies and shared prefixes."""
    rows, df = chats
    got = prefix_trie.prefix_trie(df, run, tasks)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == trie(rebuilt(rows))


def test_trie_of_nothing(chats):
    assert prefix_trie.prefix_trie(chats[1].limit(0)).count() == 0


def test_a_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == trie(rebuilt(rows)) and got[0].depth == 0 and got[0].n_leaves == 1


def test_loser_tree_merges_with_lcps_and_compares_less():
    items = sorted(([bytes([x]) for x in RNG.integers(0, 2, RNG.integers(0, 40))], i, []) for i in range(500))
    items += [([b"s"] * 40, 1000 + i, []) for i in range(300)]
    for n in (1, 2, 3, 7):
        runs = [sorted(items[k::n]) for k in range(n)]
        with_lcps = [[(0 if i == 0 else prefix_trie.lcp_of(r[i - 1][0], x[0]), x) for i, x in enumerate(r)] for r in runs]
        tree = prefix_trie.LoserTree(with_lcps)
        got = list(tree)
        assert [x for _, x in got] == sorted(items)
        assert [l for l, _ in got] == [0, *(prefix_trie.lcp_of(a[0], b[0]) for a, b in itertools.pairwise(sorted(items)))]
        # each output compares the turns it doesn't share with the last one, and one turn more at a level of the tree
        assert tree.compared <= sum(len(x[0]) for x in items) + 4 * len(items) * n
    assert tree.compared < 0.6 * sum(len(x[0]) for x in items)


def test_long_lists_of_ends_are_hashed_in_blocks(spark):
    rows = [(5 * c, t, "user", "same") for c in range(9000) for t in range(9)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tasks=3).orderBy("depth").collect()
    ends = hashlib.sha256(",".join(str(5 * c) for c in range(9000)).encode()).hexdigest()
    assert [r.n_convs for r in got] == [9000] * 10 and got[-1].ends_sha256 == ends and got[0].saved_tokens == 9 * 4 * 8999


# ---- search


def brute_top(rows, k, query, scale=64):
    there = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(there):
        if q is None or not query(q):
            continue
        scores = [(max(-(2**63), min(2**63 - 1, sum(s * t for s, t in zip(x, y)))), i) for b, (i, y) in enumerate(there) if a != b]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def found(spark, rows, k, query, kind="double", **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"id long, embedding array<{kind}>, kind string, block int").repartition(3)
    got = exact_search.exact_top_k(df, k, query, **more).collect()
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str)


def vectors(n, d, sparse=0.0):
    return [(i, [float(x) if RNG.random() >= sparse else 0.0 for x in RNG.normal(0, 0.15, d)]) for i in range(n)]


@pytest.mark.parametrize("sparse", [0.1, 0.9])
def test_search_equals_brute_force(spark, sparse):
    rows = vectors(300, 12, sparse)
    rows += [(400 + i, rows[8][1]) for i in range(90)]  # a hot vector: its copies tie
    rows += [(20, rows[3][1]), (40, rows[40][1]), (None, rows[9][1]), (None, rows[8][1]), (500, None), (520, []), (540, [1.0]), (560, [float("nan")] * 12), (580, [None] + [0.5] * 11), (600, [float("inf")] + [0.5] * 11)]
    assert found(spark, rows, 20, F.col("id") % 20 == 0) == brute_top(rows, 20, lambda q: q % 20 == 0)
    assert found(spark, rows, 3, F.col("id") > 250, tasks=7) == brute_top(rows, 3, lambda q: q > 250)


def test_search_in_blocks_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "CELL_QUERIES", 40)
    rows = vectors(11_000, 8)
    got = found(spark, rows, 5, F.col("id") % 100 == 0, "float", tasks=12)
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(single, 5, lambda q: q % 100 == 0)


def test_scores_beyond_float_precision_are_exact(spark):
    rows = [(i, [1e6 * (1 + i), 3e9 + i, -7.0 * i]) for i in range(30)] + [(90, [1e300, 1.0, 1.0]), (91, [1e300, 2.0, 1.0]), (92, [-1e300, 2.0, 1.0])]
    assert found(spark, rows, 4, F.col("id") % 10 == 0) == brute_top(rows, 4, lambda q: q % 10 == 0)


def test_search_of_few_and_none(spark):
    assert found(spark, [(0, [1.0])], 5, F.col("id") == 0) == []
    assert found(spark, [(1, [1.0])], 5, F.col("id") == 0) == []
    df = spark.createDataFrame([], "id long, embedding array<float>")
    assert exact_search.exact_top_k(df, 5, F.col("id") == 0).count() == 0


# ---- audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)))


def brute_audit(docs, labels):
    masks = []
    for d, text, lang in docs:
        again = d is not None and any(e is not None and e < d and (t or "") == (text or "") for e, t, _ in docs)
        good, toxic = (d is not None and any(x == d and y[k] == 1 for x, *y in labels) for k in (0, 1))
        masks.append((lang or "", dict(zip("ABCDE", (*fails(text or ""), again))), good, toxic))
    out = []
    for part in {m[0] for m in masks}:
        own, shapley = [m for m in masks if m[0] == part], collections.Counter()
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [m for m in left if m[1][k]]
                left = [m for m in left if not m[1][k]]
                shapley[k] += len(gone)
                redundant = sum(m[1][k] and any(m[1][j] for j in order[: step - 1]) for m in own)
                unique = sum(m[1][k] and sum(m[1].values()) == 1 for m in own)
                rows.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(m[2] for m in gone), sum(m[3] for m in gone), k))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    words = [f"w{i}" for i in range(400)]
    some = lambda n, m: " ".join(RNG.choice(words[:m], n))
    base = [some(n, m) for n in (20, 120, 150, 400) for m in (40, 400)] + [some(130, 400) + " #", some(120, 400).upper(), "", None, "\x1c\x1d \x85  ", "É" * 300, " ".join(words) * 40]
    docs = [(i, base[RNG.integers(len(base))], ["en", "fr", None, ""][i % 4]) for i in range(160)]
    docs += [(500 + i, base[3], "en") for i in range(90)]  # copies of one text
    docs += [docs[3], docs[170], (7, "other text of a repeated id", "fr"), (None, base[3], "en"), (None, "null id", "de")]
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 160, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)]
    return docs, labels


@pytest.mark.parametrize("held", [filter_audit.HELD, 1500])
def test_audit_equals_brute_force(spark, texts, held):
    docs, labels = texts
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(df, said, held).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(docs, labels)
    assert filter_audit.filter_audit(df.limit(0), said).count() == 0
    assert filter_audit.filter_audit(df, said.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_texts_that_share_a_hash_are_told_apart():
    rows = [(1, ("a", 5, "en", 1, 1)), (1, ("b", 2, "en", 1, 2)), (1, ("a", 3, "fr", 1, 1)), (1, ("b", 2, "fr", 1, 1)), (1, ("a", 9, "en", 1, 1)), (2, (None, 8, "en", 17, 1))]
    assert sorted(filter_audit.owned(rows)) == [(2, "en", 1, 2), (2, "fr", 1, 1), (3, "fr", 1, 1), (5, "en", 17, 1), (8, "en", 17, 1), (9, "en", 17, 1)]




def test_kernel_fit_by_blocks_equals_the_whole():
    from parley.llm import language

    x = (RNG.random((5000, 256)) < 0.05).astype(np.float32)
    y = np.where(RNG.random((5000, 3)) < 0.3, 1.0, -1.0)
    mark, weight = language.fit(x, y, landmarks=30)
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = (language.unit(x) @ mark.T) @ root
    whole = root @ np.linalg.solve(phi.T @ phi + 1e-2 * len(x) / len(mark) * np.eye(len(mark)), phi.T @ y)
    assert np.allclose(weight, whole, atol=1e-4)
    bits = language.fit(np.packbits(x > 0, axis=1), y, landmarks=30, opened=lambda b: np.unpackbits(b, axis=1).astype(np.float32))
    assert np.array_equal(bits[0], mark) and np.array_equal(bits[1], weight)
