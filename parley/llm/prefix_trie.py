"""Conversation prefix trie by an LCP-aware external mergesort.

A turn is known by the SHA-256 of its role and text (32 bytes) and the bytes of its text; texts are read once and are
never shuffled. A conversation is the sequence of its turns.

1. A task cuts its conversations into runs of bounded size, sorts each, and writes it to the shared folder with the LCP
   of each conversation and the one before it (the turns that both begin with).
2. The runs are dealt to tasks by ranges of (sequence, conv_id). As the id is part of the order, copies of one
   conversation, however many, part like others. A task merges the slices of the runs by a loser tree: of two heads the
   one that shares more turns with the last output is the smaller, and only if both share as many are turns compared, from
   there on.
3. The merged stream, which carries LCPs again, is turned into nodes by the stack of open nodes on the path of the last
   conversation: a node is finished, and emitted, when a conversation comes that is not below it.
4. Nodes on a task's first or last path may go on in its neighbours. All their figures are sums (and a minimum) over the
   tasks, but for what both sides of a border count; this follows from the LCP over the border, and one row a node and
   task is put together. ids of conversations that end at a node are joined in blocks of `IDS` in the order of the
   stream, which is theirs, and hashed block by block.
5. Parents' ids are joined to the nodes.

Defined cases: null roles and texts are empty; a null turn is first; turns of one number stand in the order of their
digest, repeated rows too, of which each is a turn; a null conv_id names no conversation; a conversation may be rebuilt
without turns and then ends at the root; of an empty table there is no root; a conversation is one row of 32 bytes a
turn, however long its texts; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared

#: Turns of a run, turns of a task that merges, ids of a block.
RUN, PART, IDS = 1 << 18, 1 << 19, 4096

RUNS = "run long, at long, lcp int, conv_id long, keys array<binary>, sizes array<long>"
NODES = (
    "kind string, p int, serial long, parent long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, ids string, chunk long, on_first boolean, on_last boolean, before long, first_keys array<binary>, last_keys array<binary>, uptos array<long>"
)


def crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def rebuilt(scratch: _shared.Scratch, conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of key and size): the first crc32(conv_id) % 9 turns of conversation conv_id - conv_id % 5,
    then the conversation's own after as many."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    rows = conversations.where("conv_id IS NOT NULL").select(base, F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), "key")))
    own = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "key", "size"))).alias("turns"))
    own = scratch.stored(own.select("base", "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns")), "conversations", hashes="turns.list.element.key")
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, 8).alias("heads"))
    h = (crc(F.col("conv_id")) % 9).cast("int")
    all_of = F.concat(F.slice(F.coalesce("heads", F.array().cast(own.schema["turns"].dataType)), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h)))
    return own.join(heads, "base", "left").select("conv_id", all_of.alias("turns"))


def lcp_of(a: list, b: list, start: int = 0) -> int:
    k, n = start, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    return k


def sorted_runs(size: int, batches) -> Iterator[pa.RecordBatch]:
    """Runs of about `size` turns: rows RUNS in their order."""
    from pyspark import TaskContext

    run, held, turns = TaskContext.get().partitionId() << 32, [], 0

    def emit():
        held.sort()
        lcps = [0] + [lcp_of(a[0], b[0]) for a, b in zip(held, held[1:])]
        for lo in range(0, len(held), 2000):
            some = held[lo : lo + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([run] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int64()), pa.array(lcps[lo : lo + 2000], pa.int32()), pa.array([c for _, c, _ in some], pa.int64()), pa.array([k for k, _, _ in some], pa.list_(pa.binary())), pa.array([s for _, _, s in some], pa.list_(pa.int64()))],
                names=["run", "at", "lcp", "conv_id", "keys", "sizes"],
            )

    for b in batches:
        for c, keys, sizes in zip(*(x.to_pylist() for x in b.columns), strict=True):
            held.append((keys, c, sizes))
            turns += 1 + len(keys)
            if turns >= size:
                yield from emit()
                run, turns = run + 1, 0
                held.clear()
    yield from emit()


class LoserTree:
    """Merges sorted streams of (lcp with the one before it, (keys, conv_id, sizes)) into one such stream.

    A node of the tree holds the head that lost there, with its LCP with the head that won. The losers on the way of a
    head that was output all lost to it, so their LCPs, like that of the head that takes its place, are with the last
    output: the larger LCP is the smaller sequence, and only equal ones are compared, from that turn on."""

    def __init__(self, streams: list):
        self.streams = [iter(s) for s in streams]
        n = 1
        while n < len(streams):
            n *= 2
        self.size, self.compared = n, 0
        self.heads = [next(s, None) for s in self.streams] + [None] * (n - len(streams))
        # before the first output no sequence is known to share anything with it
        self.heads = [x and (0, x[1]) for x in self.heads]
        self.losers = [None] * n
        self.top = self._play(1)

    def _beats(self, i: int, j: int) -> bool:
        """If the head i comes before the head j; the LCP of the one that does not becomes that with the other."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None
        if a[0] != b[0]:
            return a[0] > b[0]  # the loser's LCP with the winner is its LCP with the last output
        x, y = a[1], b[1]
        k = lcp_of(x[0], y[0], a[0])
        self.compared += k - a[0] + 1
        if k < min(len(x[0]), len(y[0])):
            first = x[0][k] < y[0][k]
        else:
            first = (len(x[0]), x[1]) <= (len(y[0]), y[1])
        if first:
            self.heads[j] = (k, y)
        else:
            self.heads[i] = (k, x)
        return first

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        i, j = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (i, j) if self._beats(i, j) else (j, i)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.heads[self.top] is not None:
            i = self.top
            yield self.heads[i]
            self.heads[i] = next(self.streams[i], None) if i < len(self.streams) else None
            node = (i + self.size) // 2
            while node:
                if not self._beats(i, self.losers[node]):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.top = i


class Node:
    __slots__ = ("serial", "parent", "depth", "size", "conv_id", "n", "children", "leaves", "saved", "ids", "chunks", "first", "upto")

    def __init__(self, serial: int, parent: int, depth: int, size: int, first: bool, upto: int):
        self.serial, self.parent, self.depth, self.size, self.first, self.upto = serial, parent, depth, size, first, upto
        self.conv_id, self.n, self.children, self.leaves, self.saved, self.ids, self.chunks = None, 0, 0, 0, 0, [], 0


def nodes_of(p: int, merged) -> Iterator[dict]:
    """Rows NODES of a sorted stream of (lcp, (keys, conv_id, sizes)): finished nodes, ids of those whose list is not
    whole, and one row of the stream's first and last sequence."""
    stack: list[Node] = []
    serial, first, last, uptos = 0, None, None, []

    def open_node(size: int) -> None:
        nonlocal serial
        parent = stack[-1] if stack else None
        stack.append(Node(serial, parent.serial if parent else -1, len(stack), size, first is None, parent.upto + size if parent else 0))
        serial += 1
        if parent:
            parent.children += 1

    def chunk(x: Node) -> dict:
        row = {"kind": "ids", "p": p, "serial": x.serial, "ids": ",".join(map(str, x.ids)), "chunk": x.chunks}
        x.ids, x.chunks = [], x.chunks + 1
        return row

    def close_node(on_last: bool):
        x = stack.pop()
        x.leaves += not x.children
        x.saved += (x.n - 1) * x.size
        if stack:
            up = stack[-1]
            up.n, up.leaves, up.saved = up.n + x.n, up.leaves + x.leaves, up.saved + x.saved
            up.conv_id = x.conv_id if up.conv_id is None else min(up.conv_id, x.conv_id)
        open_ended = x.first or on_last or x.chunks > 0
        if open_ended and x.ids:
            yield chunk(x)
        sha = None if open_ended else hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest()
        yield {"kind": "node", "p": p, "serial": x.serial, "parent": x.parent, "depth": x.depth, "conv_id": x.conv_id, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "ends_sha256": sha, "on_first": x.first, "on_last": on_last, "before": x.upto - x.size}

    for lcp, (keys, conv_id, sizes) in merged:
        while len(stack) > lcp + 1:
            yield from close_node(False)
        if not stack:
            open_node(0)
        for size in sizes[len(stack) - 1 :]:
            open_node(size)
        end = stack[-1]
        end.ids.append(conv_id)
        end.n += 1
        end.conv_id = conv_id if end.conv_id is None else min(end.conv_id, conv_id)
        if len(end.ids) >= IDS:
            yield chunk(end)
        if first is None:
            first, uptos = keys, [x.upto for x in stack]
        last = keys
    while stack:
        yield from close_node(True)
    if first is not None:
        yield {"kind": "edge", "p": p, "first_keys": first, "last_keys": last, "uptos": uptos}


def merged_nodes(columns: list[str], kinds: pa.Schema, batches) -> Iterator[pa.RecordBatch]:
    """A task's nodes: its slices of the runs, merged."""
    from pyspark import TaskContext

    runs: dict[int, list] = {}
    for b in batches:
        for run, at, lcp, conv_id, keys, sizes in zip(*(b.column(c).to_pylist() for c in ("run", "at", "lcp", "conv_id", "keys", "sizes")), strict=True):
            runs.setdefault(run, []).append((at, lcp, (keys, conv_id, sizes)))

    def stream(rows):
        rows.sort(key=lambda r: r[0])
        return ((lcp, x) for _, lcp, x in rows)

    out = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], kinds.field(c).type) for c in columns], names=columns)

    for row in nodes_of(TaskContext.get().partitionId(), LoserTree([stream(x) for x in runs.values()])) if runs else ():
        out.append(row)
        if len(out) >= 5000:
            yield batch()
            out.clear()
    yield batch()


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _borders(scratch: _shared.Scratch, edges: DataFrame) -> DataFrame:
    """A row a task with rows, but the first: p, over (the turns that the sequences at its border with the task before it
    share), upto_over (bytes of these), ended (if the last sequence of the task before has no more turns than these)."""
    spark = edges.sparkSession
    there = sorted(r.p for r in edges.select("p").collect())  # a number a task
    before = spark.createDataFrame(list(zip(there[1:], there[:-1], strict=True)), "p int, q int")
    one = edges.select("p", "first_keys", "uptos").join(before, "p").join(edges.select(F.col("p").alias("q"), "last_keys"), "q")
    unlike = F.array_position(F.zip_with("first_keys", "last_keys", lambda a, b: a.eqNullSafe(b)), False)
    over = F.when(unlike > 0, unlike - 1).otherwise(F.size("first_keys").cast("long"))
    one = one.withColumn("over", over)
    one = one.select("p", "over", F.element_at("uptos", (F.col("over") + 1).cast("int")).alias("upto_over"), (F.size("last_keys") == F.col("over")).alias("ended"))
    return _shared.broadcast_if_small(scratch.keep(scratch.stored(one, "borders")))


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """(p, serial, sha) of nodes, by the sorted stream of (np, ns, ids)."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], names=["p", "serial", "sha"])

    for b in batches:
        for p, serial, ids in zip(*(b.column(c).to_pylist() for c in ("np", "ns", "ids")), strict=True):
            if (p, serial) != at:
                if at:
                    yield row()
                at, state = (p, serial), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if at:
        yield row()


def prefix_trie(conversations: DataFrame, run: int = RUN, tasks: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    conversations(conv_id, turn, role, text, ...), rebuilt. run: turns of a run; tasks: at least so many merge."""
    with _shared.Scratch() as scratch:
        return trie_of(scratch, rebuilt(scratch, conversations), run, tasks)


def trie_of(scratch: _shared.Scratch, sequences: DataFrame, run: int, tasks: int | None) -> DataFrame:
    """The trie of sequences(conv_id, turns)."""
    spark = sequences.sparkSession
    runs = sequences.select("conv_id", "turns.key", "turns.size").mapInArrow(functools.partial(sorted_runs, run), RUNS)
    runs = scratch.stored(runs, "runs", hashes="keys.list.element")
    turns = runs.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    parts = max(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), turns // PART)
    kinds = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in NODES.split(", ")])
    rows = runs.repartitionByRange(parts, "keys", "conv_id").mapInArrow(functools.partial(merged_nodes, kinds.names, kinds), NODES)
    rows = scratch.keep(scratch.stored(rows, "trie"))
    borders = _borders(scratch, rows.where("kind = 'edge'"))

    # nodes on first or last paths: those of one depth that follow each other over borders are one node, named as its
    # first row is; p and serial name a node
    node = rows.where("kind = 'node'")
    path = node.where("on_first OR on_last").join(borders, "p", "left")
    path = path.withColumn("goes_on", F.col("on_first") & (F.col("depth") <= F.coalesce("over", F.lit(-1))))
    path = path.withColumn("g", F.sum((~F.col("goes_on")).cast("long")).over(W.partitionBy("depth").orderBy("p", F.desc("on_first"))))
    one = W.partitionBy("depth", "g")
    path = path.withColumn("least", F.min("conv_id").over(one)).withColumn("name", F.min(F.struct("p", "serial")).over(one))
    path = scratch.keep(scratch.stored(path, "paths"))
    over = lambda x: F.sum(F.when(F.col("goes_on"), x).otherwise(0))
    whole = path.groupBy("depth", "name").agg(
        F.first("least").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        (F.sum("n_children") - over((F.col("depth") < F.col("over")).cast("long"))).alias("n_children"),
        (F.sum("n_leaves") - over(F.col("ended").cast("long"))).alias("n_leaves"),
        # of each node that both sides of a border have, from this one down, one conversation more is saved
        (F.sum("saved_tokens") + over(F.col("upto_over") - F.col("before"))).alias("saved_tokens"),
        F.min(F.struct("p", "parent")).alias("up"),
    )
    figures = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = node.where("NOT on_first AND NOT on_last")
    found = inner.select("p", "serial", F.col("p").alias("up_p"), F.col("parent").alias("up_serial"), "ends_sha256", *figures)
    found = found.union(whole.select("name.p", "name.serial", "up.p", "up.parent", F.lit(None).cast("string"), *figures))

    ids = rows.where("kind = 'ids'").select("p", "serial", "chunk", "ids").join(path.select("p", "serial", "name"), ["p", "serial"], "left")
    ids = ids.select(F.coalesce("name.p", "p").alias("np"), F.coalesce("name.serial", "serial").alias("ns"), "p", "chunk", "ids")
    ends = ids.repartition("np", "ns").sortWithinPartitions("np", "ns", "p", "chunk").mapInArrow(_hashed, "p int, serial long, sha string")

    above = inner.where("n_children > 0").select("p", "serial", "conv_id").union(path.select("p", "serial", "least"))
    above = above.select(F.col("p").alias("up_p"), F.col("serial").alias("up_serial"), F.col("conv_id").alias("parent_conv_id"))
    found = found.join(ends, ["p", "serial"], "left").join(above, ["up_p", "up_serial"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


ORACLE = """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS t FROM o GROUP BY c),
x AS (SELECT c, t, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS crc FROM l),
r AS (SELECT x.c, list_concat(coalesce(b.t, [])[1:xor(x.crc, 4294967295) % 9], x.t[xor(x.crc, 4294967295) % 9 + 1:]) AS t FROM x LEFT JOIN l b ON b.c = x.c - x.c % 5),
p AS (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM r),
n AS (SELECT d, t[1:d] AS prefix, min(c) AS conv_id, count(*) AS n, coalesce(strlen(t[1:d][d].text), 0) AS bytes,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(t) = d), '')) AS ends FROM p GROUP BY d, t[1:d])
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, count(*) FILTER (s.d = v.d + 1) AS n_children,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM n y WHERE y.d = s.d + 1 AND y.prefix[1:s.d] = s.prefix)) AS n_leaves,
  CAST(sum((s.n - 1) * s.bytes) AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM n v JOIN n s ON s.d >= v.d AND s.prefix[1:v.d] = v.prefix LEFT JOIN n u ON u.d = v.d - 1 AND v.prefix[1:u.d] = u.prefix
GROUP BY v.conv_id, v.d, v.prefix, u.conv_id, v.n, v.ends
"""


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
