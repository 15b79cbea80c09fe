"""n-gram Jaccard join by signature trees; exact.

A document is the set of its distinct word shingles (64-bit hashes). Sets with equal hashes form a class; classes
are what is joined, so copies are never paired.
 1. A sketch of all documents' token counts (a table of 2**SKETCH_BITS counters, of fixed size) orders tokens by
    frequency; the order is the same for all sets, so it may be rough.
 2. Two sets of the similarity asked for share a token among the rarest n - ceil(t*n) + 1 of each. Tokens that
    two classes have there are cells; a cell of more than CELL classes is dealt to tasks as pairs of blocks.
 3. A cell's classes, sorted by size, are leaves of a signature tree: a node holds the union of the bitmaps of the
    prefixes below it, the range of set sizes and the largest number of tokens that bitmaps merge. The tree is traversed
    against itself; a pair of nodes is left out when bits in common plus merged tokens cannot give the overlap that
    prefixes of such sizes need, or by the size ranges; of rows, also by the places of the cell's token in both.
 4. Candidates are verified on the whole sets. The first round takes the cells of a class's FEW rare tokens of
    least hash, which near copies mostly share, and of them for every class its likeliest earlier partner; two more do
    the same with partners in other components than the class's. This joins large groups of near copies without all
    their pairs. The last takes all cells and all candidates between classes
    that are not yet connected, but for pairs that cannot give the overlap by the tokens that each of them has to itself
    (counted over all classes in cells), and only in cells that can be of a pair's rarest common token. Nothing is
    capped.
 5. In the last round pairs are rows only where one of the classes is in no cell of more than LARGE. Any other class has a
    group, which is a block of the largest of its cells; cells then say which classes of two groups have candidates in
    each other, and a task compares these on their whole sets and gives the stars of what is linked (with n_links: all
    links). So rows grow with the size of a large group of near copies, and not with its pairs.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are their own component
(component_id is their doc_id); texts of fewer words than the shingle size are one shingle; repeated rows are in one
class; a null doc_id never names a component unless all its documents' ids are null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shingles import mix, shingled

SKETCH_BITS, SEGMENT_BITS, BITS, CELL, LEAF, FAN, FEW, LARGE = 21, 16, 1024, 512, 16, 8, 6, 64
#: Rows that a Python worker gets at a time: of texts, or of pairs of whole sets.
BATCH = 2000
#: The part of the tokens that is counted first, in times the share that a linked set may lack.
PART = 1.75


def sets_of(column: pa.Array, size: int):
    for x in shingled(column, size):
        yield np.unique(x)


def class_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def frequency_levels(documents: DataFrame, size: int) -> np.ndarray:
    """For each slot of the sketch, the binary logarithm of how far its count is above four times the mean."""

    def counted(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            held = []
            for s in sets_of(b.column(0), size):
                held.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64))
                if len(held) >= 2000:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
        few = np.minimum(counts, 255).astype(np.uint8)
        # a task's counts end at 255, which changes the order of tokens but not that all documents share it; where
        # most slots are in use they are sent without places
        rows = {"segment": [], "at": [], "n": []}
        for k, part in enumerate(few.reshape(-1, 1 << SEGMENT_BITS)):
            at = np.flatnonzero(part)
            dense = 3 * len(at) > len(part)
            rows["segment"].append(k)
            rows["at"].append(b"" if dense else at.astype("<u2").tobytes())
            rows["n"].append(part.tobytes() if dense else part[at].tobytes())
        yield pa.RecordBatch.from_pydict({"segment": pa.array(rows["segment"], pa.int32()), "at": pa.array(rows["at"], pa.binary()), "n": pa.array(rows["n"], pa.binary())})

    def summed(batches):
        totals = {}
        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = totals.setdefault(k, np.zeros(1 << SEGMENT_BITS, np.int64))
                t[np.frombuffer(at, "<u2") if at else slice(len(n))] += np.frombuffer(n, np.uint8)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.astype("<i8").tobytes() for t in totals.values()], pa.binary())], names=["segment", "n"])

    parts = documents.select("text").mapInArrow(counted, "segment int, at binary, n binary")
    total = np.zeros((1 << (SKETCH_BITS - SEGMENT_BITS), 1 << SEGMENT_BITS), np.int64)
    for r in parts.repartition(total.shape[0], "segment").mapInArrow(summed, "segment int, n binary").toLocalIterator():
        total[r.segment] += np.frombuffer(r.n, "<i8")
    total = total.reshape(-1)
    return np.minimum(255, np.log2(1 + total // max(1, 4 * int(total.mean())))).astype(np.uint8)


def signature(prefix: np.ndarray) -> bytes:
    """The bitmap of a set's prefix."""
    bits = np.zeros(BITS, bool)
    bits[(prefix >> np.uint64(40)).astype(np.int64) % BITS] = True
    return np.packbits(bits).tobytes()


def prefix_size(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def prefix_overlap(n, m, num: int, den: int):
    """The tokens that the prefixes of linked sets of n and m tokens share at least: beyond them only the rest of one
    set can be common."""
    return -(-num * (n + m) // (num + den)) - -(-num * np.maximum(n, m) // den) + 1


def described(documents: DataFrame, size: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """doc_id, th, n, k1, k2 (hashes of the set), sig, prefix (its rarest tokens) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def lists(of):
        off = np.concatenate([[0], np.cumsum([len(p) for p in of])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int64), *of])))

    def rows(batches):
        level = shared.value
        for b in batches:
            n, k1, k2, sig, prefix, few = [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in sets_of(b.column(2), size):
                    n.append(len(s))
                    for k, h in zip((k1, k2), class_hashes(s), strict=True):
                        k.append(h)
                    o = np.lexsort((s, level[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]))
                    rare = s[o[: prefix_size(len(s), num, den)]] if len(s) else s
                    sig.append(signature(rare) if len(s) else b"")
                    prefix.append(rare.view(np.int64))
                    # mix is a bijection: the tokens whose mixed hashes are least, which near copies mostly share
                    few.append(rare[np.argsort(mix(rare))[:FEW]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), lists(prefix), lists(few)], names=["doc_id", "th", "n", "k1", "k2", "sig", "prefix", "few"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return docs.mapInArrow(rows, "doc_id long, th long, n long, k1 long, k2 long, sig binary, prefix array<long>, few array<long>")


class SignatureTree:
    """Levels of nodes over rows sorted by size; a node of level l covers FAN**l leaves of LEAF rows."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, num: int, den: int):
        """n: sizes of the sets; sig: bitmaps of their prefixes."""
        self.n, self.sig, self.num, self.den = n, sig, num, den
        self.many = prefix_size(n, num, den)
        self.merged = self.many - np.bitwise_count(sig).sum(1)
        cut = np.arange(0, len(n), LEAF)
        level = (np.bitwise_or.reduceat(sig, cut), np.minimum.reduceat(n, cut), np.maximum.reduceat(n, cut), np.maximum.reduceat(self.merged, cut))
        self.levels = [level]
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), FAN)
            level = tuple(f.reduceat(x, cut) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True))
            self.levels.append(level)

    def pairs(self):
        """Blocks of rows (i, j, bound), i < j, that may be linked; bound is the most tokens their prefixes can share."""
        num, den, waiting = self.num, self.den, [(len(self.levels) - 1, 0, 0)]
        while waiting:
            l, a, b = waiting.pop()
            bits, low, high, merged = self.levels[l]
            if den * min(high[a], high[b]) < num * max(low[a], low[b]):
                continue
            most = int(np.bitwise_count(bits[a] & bits[b]).sum()) + min(merged[a], merged[b])
            # the least that is asked for is at the most unlike sizes; rounding may change it by one
            if most < min(prefix_overlap(low[a], high[b], num, den), prefix_overlap(high[a], low[b], num, den)) - 1:
                continue
            if l:
                top = len(self.levels[l - 1][1])
                for x in range(a * FAN, min(top, a * FAN + FAN)):
                    waiting += [(l - 1, x, y) for y in range(max(x, b * FAN) if a == b else b * FAN, min(top, b * FAN + FAN))]
                continue
            i, j = np.arange(a * LEAF, min(len(self.n), a * LEAF + LEAF)), np.arange(b * LEAF, min(len(self.n), b * LEAF + LEAF))
            bound = np.bitwise_count(self.sig[i][:, None] & self.sig[j][None]).sum(2) + np.minimum.outer(self.merged[i], self.merged[j])
            bound = np.minimum(bound, np.minimum.outer(self.many[i], self.many[j]))
            n, m = self.n[i][:, None], self.n[j][None]
            ok = (bound >= prefix_overlap(n, m, num, den)) & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (i[:, None] < j[None])
            x, y = np.nonzero(ok)
            if len(x):
                yield i[x], j[y], bound[x, y]


def candidates(cells: DataFrame, num: int, den: int, all_pairs: bool) -> DataFrame:
    """(a, b), a < b, of classes that may be linked; with all_pairs (u, v, k): where k is null classes u and v may be
    linked, else class k may be with others of groups u and v, u <= v. cells: part (a cell's key), block (of the row), two (the part
    compares two blocks), k1, n, sig, root, at (the token's place in the set's order, or 0 to know nothing of it), alone
    (tokens of the set that no other class here has), home (the class's group, or 0).
    Without all_pairs each class has one earlier partner, the likeliest of those in all its cells; with it a pair comes
    from the cells that can be of its rarest common token. Pairs of one root are never given."""

    def of_cell(k1, n, sig, root, block, at, alone, home, two):
        o = np.lexsort((k1, n))
        k1, n, sig, root, block, at, alone, home = k1[o], n[o], sig[o], root[o], block[o], at[o], alone[o], home[o]
        if (root == root[0]).all():
            return
        tree = SignatureTree(n, sig, num, den)
        found = list(tree.pairs())
        if not found:
            return
        i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        # the token is at these places of both sets' orders: what is before in both, and what is from there on
        most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
        most = np.minimum(most, np.minimum(n[i] - alone[i], n[j] - alone[j]))
        ok = (root[i] != root[j]) & ((block[i] != block[j]) if two else True) & (most * (num + den) >= num * (n[i] + n[j]))
        if all_pairs:
            # all common tokens but those before it are from the rarest one on, so that is no later than this in both
            near = prefix_overlap(n[i], n[j], num, den)
            ok &= (at[i] <= tree.many[i] - near) & (at[j] <= tree.many[j] - near)
        i, j, bound = i[ok], j[ok], bound[ok]
        near = bound / (tree.many[i] + tree.many[j])
        if not all_pairs and len(i):
            o = np.lexsort((-near, j))
            o = o[np.concatenate([[True], np.diff(j[o]) > 0])]
            i, j, near = i[o], j[o], near[o]
        if all_pairs:
            grouped = (home[i] != 0) & (home[j] != 0)
            x, y = i[grouped], j[grouped]
            names, h = np.unique(home, return_inverse=True)
            of = np.minimum(h[x], h[y]) * len(names) + np.maximum(h[x], h[y])
            both = np.unique(np.concatenate([of * len(k1) + x, of * len(k1) + y]))
            of, k = both // len(k1), both % len(k1)
            yield names[of // len(names)], names[of % len(names)], k1[k], np.ones(len(k), bool)
            i, j = i[~grouped], j[~grouped]
            yield np.minimum(k1[i], k1[j]), np.maximum(k1[i], k1[j]), np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        else:
            yield k1[i], k1[j], near

    def paired(batches):
        held, out = None, []

        def marks():
            u, v, k, grouped = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, np.int64, bool), zip(*out, strict=True) if out else ([],) * 4, strict=True))
            out.clear()
            rows = np.unique(np.stack([u, v, k, grouped], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2], mask=rows[:, 3] == 0)], names=["u", "v", "k"])

        def emit():
            if all_pairs:
                return marks()
            a, b, near = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, float), zip(*out, strict=True) if out else ([], [], []), strict=True))
            out.clear()
            if len(a):
                o = np.lexsort((a, -near, b))
                o = o[np.concatenate([[True], b[o][1:] != b[o][:-1]])]
                a, b, near = a[o], b[o], near[o]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], names=["a", "b", "near"])

        def cells_of(t, last):
            part = t.column(0).to_numpy(zero_copy_only=False)
            sub = t.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((part[1:] != part[:-1]) | (sub[1:] != sub[:-1])) + 1
            cut = np.concatenate([[0], cut, [len(part)]])
            ends = cut if last else cut[:-1]
            cols = [t.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5, 7, 8, 9, 10)]
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint64).reshape(len(part), BITS // 64)
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                if y - x > 1:
                    block, two, k1, n, root, at, alone, home = (c[x:y] for c in cols)
                    out.extend(of_cell(k1, n, sig[x:y], root, block, at, alone, home, bool(two[0])))
            return t.slice(ends[-1])

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = cells_of(t.combine_chunks(), False) if len(t) else None
            if sum(len(x) for x, *_ in out) > 100_000:
                yield emit()
        if held is not None and len(held):
            cells_of(held.combine_chunks(), True)
        yield emit()

    rows = cells.select("token", "part", "block", "two", "k1", "n", "sig", "root", "at", "alone", "home").repartition("token", "part").sortWithinPartitions("token", "part")
    found = rows.mapInArrow(paired, "u long, v long, k long" if all_pairs else "a long, b long, near double")
    if all_pairs:
        return found.distinct()
    best = found.groupBy("b").agg(F.max_by("a", F.struct("near", "a")).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common_tokens(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets in x with sets in y."""
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    _, at, count = np.unique(np.concatenate(x + y), return_inverse=True, return_counts=True)
    # tokens of many sets are columns of a matrix, some at a time, those of few give their pairs
    out, many = np.zeros((len(x), len(y)), np.float32), np.flatnonzero(count >= 16)
    for k in range(0, len(many), 4096):
        place = np.full(len(count), -1)
        place[many[k : k + 4096]] = np.arange(len(many[k : k + 4096]))
        held = np.zeros((len(x) + len(y), len(many[k : k + 4096])), np.float32)
        here = place[at] >= 0
        held[row[here], place[at[here]]] = 1
        out += held[: len(x)] @ held[len(x) :].T
    few = (count[at] > 1) & (count[at] < 16)
    o = np.argsort(at[few], kind="stable")
    at, row = at[few][o], row[few][o]
    for d in range(1, 15):
        i = np.flatnonzero((at[d:] == at[:-d]) & (row[:-d] < len(x)) & (row[d:] >= len(x)))
        out += np.bincount(row[i] * len(y) + row[i + d] - len(x), minlength=out.size).reshape(out.shape)
    return out.astype(np.int64)


def compared(marks: DataFrame, num: int, den: int, links: bool) -> DataFrame:
    """(a, b) of the links between classes k that marks(u, v, k, home, root, tokens) name in groups u and v: all of them,
    or edges that connect the same classes."""

    def of_groups(k, root, first, second, tokens):
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in tokens]
        x, y = np.flatnonzero(first), np.flatnonzero(second)
        n = np.array([len(s) for s in sets])
        same = common_tokens([sets[i] for i in x], [sets[i] for i in y])
        ok = (den * same >= num * (n[x][:, None] + n[y][None] - same)) & (k[x][:, None] != k[y][None])
        if not links:
            ok &= root[x][:, None] != root[y][None]
        i, j = np.nonzero(np.triu(ok) if len(x) == len(y) == len(k) else ok)  # one group with itself
        a, b = k[x[i]], k[y[j]]
        return (np.minimum(a, b), np.maximum(a, b)) if links else _shared.forest(a, b)

    def linked(batches):
        held = None

        def keys_of(t, last):
            u, v, k, home, root = (t.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            cut = np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1
            cut = np.concatenate([[0], cut, [len(u)]])
            ends = cut if last else cut[:-1]
            found = []
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                found.append(of_groups(k[x:y], root[x:y], home[x:y] == u[x], home[x:y] == v[x], t.column(5)[x:y]))
            a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*found, strict=True) if found else ([], [])))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]), t.slice(ends[-1])

        for r in batches:
            t = pa.Table.from_batches([r]) if held is None else pa.concat_tables([held, pa.Table.from_batches([r])])
            if len(t):
                out, held = keys_of(t.combine_chunks(), False)
                yield out
        if held is not None and len(held):
            yield keys_of(held.combine_chunks(), True)[0]

    rows = marks.select("u", "v", "k", "home", "root", "tokens").repartition("u", "v").sortWithinPartitions("u", "v")
    return rows.mapInArrow(linked, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are linked."""

    def linked(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("k1").alias("a"), F.col("tokens").alias("x")), "a")
    return one.join(sets.select(F.col("k1").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(linked, "a long, b long")


def similar_documents(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100, links: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, root of every row; texts link when
    den * intersection >= num * union. root (null for an empty set) tells components apart, which component_id
    does not where doc_id is null or repeated. links: there is one round only, in which every candidate pair of classes
    is verified, and n_links is the number of other rows that a row links with, copies among them."""
    with _shared.Scratch() as scratch, _shared.smaller_batches(documents.sparkSession, BATCH):
        return scratch.keep(_similar(scratch, documents.select("doc_id", "text"), size, num, den, links))


def _similar(scratch: _shared.Scratch, documents: DataFrame, size: int, num: int, den: int, links: bool) -> DataFrame:
    rows = scratch.stored(described(documents, size, num, den, frequency_levels(documents, size)), "sets")
    classes = scratch.stored(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")), "classes")
    # a class is (k1, k2) and is named by k1; where classes share it, both halves make the name
    clash = scratch.stored(classes.groupBy("k1").agg(F.min("k2").alias("x"), F.max("k2").alias("y")).where("x <> y").select(F.col("k1").alias("c")), "clash")
    if clash.limit(1).count():
        renamed = lambda t: t.join(_shared.broadcast_if_small(clash), F.col("k1") == F.col("c"), "left").withColumn("k1", F.when(F.col("c").isNull(), F.col("k1")).otherwise(F.xxhash64("k1", "k2"))).drop("c")
        rows, classes = scratch.stored(renamed(rows), "sets"), scratch.stored(renamed(classes), "classes")
    tokens = rows.select("k1", F.explode("prefix").alias("token"))
    # copies share their k1, so a token that only one class has drops out here, and copies meet before the shuffle
    again = tokens.groupBy("token").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x <> y").select("token")
    again = _shared.broadcast_if_small(scratch.stored(again, "again"), _shared.BROADCAST_LONGS)
    members = scratch.stored(rows.select("k1", "n", F.posexplode("prefix").alias("at", "token")).join(again, "token").distinct(), "members", hashes=True)
    starters = scratch.stored(rows.select("k1", "n", F.lit(0).alias("at"), F.explode("few").alias("token")).join(again, "token").distinct(), "starters", hashes=True)
    slim = scratch.stored(rows.select("doc_id", "th", "n", "k1", "k2"), "rows")

    def dealt(cells: DataFrame) -> DataFrame:
        """The rows of cells (token, k1, n, df), with a row for each part that a block of a large cell is in."""
        blocks = F.ceil(F.col("df") / CELL).cast("int")
        block = F.pmod(F.xxhash64("k1"), blocks).cast("int")
        out = cells.withColumn("blocks", blocks).withColumn("block", block)
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        # a part of one block compares its rows with each other, a part of two blocks only rows of different blocks
        part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
        return out.select("token", part.cast("long").alias("part"), "block", (F.col("block") != F.col("other")).alias("two"), "k1", "n", "at")

    def groups(cells: DataFrame) -> DataFrame:
        """(k1, home) of the classes in a cell of more than LARGE: home is a block of the largest such cell, of about CELL
        classes, or less where their sets are large."""
        cell = cells.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / (256 * CELL))).alias("blocks"))
        own = cells.where(F.col("df") > LARGE).groupBy("k1").agg(F.max(F.struct("df", "token"))["token"].alias("token"))
        return own.join(cell, "token").select("k1", F.xxhash64("token", F.pmod(F.xxhash64("k1"), "blocks")).alias("home"))

    needed = _shared.broadcast_if_small(scratch.stored(members.select("k1").distinct(), "needed"), _shared.BROADCAST_LONGS)
    one = F.min(F.struct("doc_id", "th"))  # a row of the class: ids may be null or repeated, so its text's hash goes with it
    wanted = rows.join(needed, "k1").groupBy("k1", "k2").agg(one.alias("row"), F.first("sig").alias("sig"))
    wanted = scratch.stored(wanted.select("k1", "k2", "row.doc_id", "row.th", "sig"), "wanted")
    scratch.drop(rows)

    def whole(batches):
        for b in batches:
            k2, raw = [], []
            for s in sets_of(b.column(2), size):
                k2.append(class_hashes(s)[1])
                raw.append(s.tobytes())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["k1", "tokens"])
            yield out.filter(pc.equal(pa.array(k2, pa.int64()), b.column(1)))

    def texts_of(here: DataFrame) -> DataFrame:
        """(want, k2, text) of the classes in here(k1); of a class whose row is repeated perhaps as often."""
        ids = wanted.select("k1", "k2", "doc_id", "th").join(_shared.broadcast_if_small(here, _shared.BROADCAST_LONGS), "k1", "left_semi").select(F.col("k1").alias("want"), "k2", F.col("doc_id").alias("d"), F.col("th").alias("h"))
        ids = _shared.broadcast_if_small(scratch.stored(ids, "ids"))
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").join(ids, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))
        return docs.select("want", "k2", "text")

    def sets_in(here: DataFrame) -> DataFrame:
        return scratch.stored(texts_of(here).mapInArrow(whole, "k1 long, tokens binary"), "tokens", hashes=True)

    def unshared(here: DataFrame, share: float, name: str) -> DataFrame:
        """(k1, alone): the tokens, of those whose hash is in the lowest share, that no other class in here(k1) has."""
        bound = np.uint64(min(2**64 - 1, int(share * 2**64)))

        def rows(batches):
            for b in batches:
                for t in whole([b]):
                    raw = [np.frombuffer(x, np.uint64) for x in t.column(1).to_pylist()]
                    low = [x[x <= bound] for x in raw]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *low]).view(np.int64)), pa.array(np.repeat(t.column(0).to_numpy(), [len(x) for x in low]), pa.int64())], names=["token", "k1"])

        owners = texts_of(here).mapInArrow(rows, "token long, k1 long").groupBy("token").agg(F.min("k1").alias("k1"), F.max("k1").alias("y")).where("k1 = y")
        return scratch.stored(owners.groupBy("k1").agg(F.count("*").alias("alone")), name)

    spare = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den))  # tokens that a linked set may lack

    # what a class has to itself is common to no pair. A part of the tokens is counted first, which leaves few classes of
    # which all are; linked classes are both left
    left = scratch.stored(members.select("k1", "n").distinct(), "left")
    for share, name in ((min(1.0, PART * (1 - num / den)), "part"), (1.0, "alone")):
        alone = unshared(left.select("k1"), share, name)
        left = left.select("k1", "n").join(_shared.broadcast_if_small(alone), "k1", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        left = scratch.stored(left.where(F.col("alone") <= spare), "left")
    here = _shared.broadcast_if_small(left.select("k1"), _shared.BROADCAST_LONGS)
    members, starters = (scratch.stored(t.join(here, "k1", "left_semi"), "members", hashes=True) for t in (members, starters))
    wanted = scratch.stored(wanted.join(_shared.broadcast_if_small(left.select("k1", "alone")), "k1"), "wanted")

    root, edges = None, None
    for all_pairs in (True,) if links else (False, False, False, True):
        signed = wanted.select("k1", "sig", "alone", F.col("k1").alias("root"))
        cells = members if all_pairs else starters
        if root is None:
            sizes = cells.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        else:
            # only cells whose classes are not yet all connected
            signed = wanted.select("k1", "sig", "alone").join(root, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
            known = cells.select("token", "k1").join(_shared.broadcast_if_small(root), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
            sizes = known.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token", "df")
        sizes = _shared.broadcast_if_small(scratch.stored(sizes, "open"), _shared.BROADCAST_LONGS // 2)
        cells = cells.join(sizes, "token")
        if all_pairs:
            grouped = scratch.stored(groups(cells), "groups", hashes=True)
            signed = signed.join(_shared.broadcast_if_small(grouped), "k1", "left").withColumn("home", F.coalesce("home", F.lit(0)))
        else:
            signed = signed.withColumn("home", F.lit(0).cast("long"))
        cells = scratch.stored(dealt(cells), "cells", hashes=True)
        pairs = candidates(cells.join(_shared.broadcast_if_small(signed, 100_000), "k1"), num, den, all_pairs)
        given = pairs = scratch.stored(pairs, "pairs")
        scratch.drop(cells)
        if all_pairs:
            pairs = given.where("k IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b"))
            marks = given.where("k IS NOT NULL")
        here = pairs.select(F.col("a").alias("k1")).union(pairs.select(F.col("b").alias("k1")))
        here = (here.union(marks.select("k")) if all_pairs else here).distinct()
        tokens = sets_in(scratch.stored(here, "here"))
        found = verified(pairs, tokens, num, den)
        if all_pairs:
            homes = _shared.broadcast_if_small(signed.select(F.col("k1").alias("k"), "home", "root").where("home <> 0"))
            # texts of one class may be repeated
            sets = tokens.withColumnRenamed("k1", "k").dropDuplicates(["k"])
            found = found.union(compared(marks.join(homes, "k").join(sets, "k"), num, den, links))
        found = scratch.stored(found.distinct() if links else found, "links")
        scratch.drop(tokens, given)
        edges = found if edges is None else edges.union(found)
        root = scratch.stored(_shared.components(edges).withColumnRenamed("node", "k1"), "roots")
    named = classes.select("k1", "k2", "doc_id").join(root, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = scratch.stored(named.join(names, "root").select("k1", "k2", "component_id", "root"), "names")
    out = slim.join(named, ["k1", "k2"], "left")
    more = []
    if links:
        copies = scratch.stored(slim.where("n > 0").groupBy("k1").agg(F.count("*").alias("copies")), "copies")
        both = edges.select("a", "b").union(edges.select("b", "a"))
        others = both.join(copies, F.col("b") == F.col("k1")).groupBy("a").agg(F.sum("copies").alias("others"))
        counts = copies.join(others, F.col("k1") == F.col("a"), "left").select("k1", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        out = out.join(scratch.stored(counts, "counts"), "k1", "left")
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    out = out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root", *more)
    return scratch.stored(out, "similar")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i + 3], ' '))) AS sh FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS r FROM edge UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(r) FROM reach WHERE node = doc_id), doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""


def op3_signature_tree_join(spark, sf_dir):
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100).drop("th", "root")


ORACLE_WHOLE = ORACLE.replace("AS component_id\n", "AS component_id, (SELECT count(*) FROM edge WHERE edge.a = w.doc_id) AS n_links\n")


def op3_signature_tree_join_whole(spark, sf_dir):
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100, links=True).drop("th", "root")
