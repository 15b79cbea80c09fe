"""Token-id files with Re-Pair grammar compression.

Documents are dealt to shards by ranges of doc_id, so that shards in order hold ascending ids. A task encodes
its shard in order and writes a row for each block of about `block` ids; one block holds whole documents and a
grammar of its own:

    shard, block      place in the order of the file
    n_ids             ids that the block stands for
    doc_id            ids of its documents, in order
    rules             uint32 pairs: the two symbols that nonterminal `first_rule + i` replaces
    lengths           uint32: the ids that each nonterminal expands to, for random access
    symbols           uint32: the compressed ids of all documents
    doc_symbols       symbols of each document; no nonterminal runs over the end of one
    first_rule        smallest nonterminal

Rows are Parquet in the shared folder. Re-Pair works in rounds: each counts all adjacent pairs, gives the most
frequent ones (up to `pairs`, each seen at least `least` times) a nonterminal, and replaces their occurrences
from left to right, until no pair is left that is seen so often. Reading expands the grammar; `decode_documents` needs only the symbols of the documents
asked for.

Defined cases: null text is empty (its document is the end id alone); repeated rows are documents of their own,
rows of one doc_id (ties) follow each other by the hash of their text, null ids come first; a text may have any length,
and one of more than a block ends its block; an empty table gives no rows; further columns of any name are
ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared, _tokens

BLOCK = "shard long, block long, n_ids long, doc_id array<long>, rules binary, lengths binary, symbols binary, doc_symbols array<long>, first_rule long"

#: Shards whose sizes are summed in one task; a group's worth of documents is GROUP * docs_per_shard.
GROUP = 4096
#: Bits of the table of a round's pairs and of the one that counts them, and a factor that spreads keys over both.
_SLOTS, _COUNT_SLOTS, _SPREAD = 18, 20, np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, rounds: int | None = None, pairs: int = 8192, least: int = 8):
    """(symbols, ends of the documents in them, rules, lengths); ends: each document's end in ids.
    Without rounds it goes on until no pair is seen `least` times."""
    rules, lengths, seq, ends = [], [], ids.astype(np.uint32), np.asarray(ends)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    last[-1:] = True
    # A pair of symbols that stay is seen less often from round to round, and all pairs of a new nonterminal come with it.
    # So a place whose pair was seen too seldom is not looked at again until one of its symbols is replaced.
    active = np.flatnonzero(~last)
    for _ in itertools.count() if rounds is None else range(rounds):
        key = seq[active].astype(np.uint64) << np.uint64(32) | seq[active + 1]
        # a pair that is seen often makes its slot full, so only pairs in full slots are sorted to be counted
        bits = min(_COUNT_SLOTS, len(active).bit_length() + 2)
        slot = ((key * _SPREAD) >> np.uint64(64 - bits)).astype(np.int32)
        full = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])
        active, key = active[full], key[full]
        some, n = np.unique(key, return_counts=True)
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        if len(often) > pairs:
            often = np.sort(often[np.lexsort((some[often], -n[often]))[:pairs]])
        # one table slot for each chosen pair; of pairs that share a slot, one waits for the next round
        slot = lambda x: ((x * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        table = np.zeros(1 << _SLOTS, np.uint64)
        table[slot(some[often])] = some[often]
        here = slot(key)
        chosen = table[here] == key
        hit, at_slot = active[chosen], here[chosen]
        # of a run of hits that overlap, every second one counts, from the left
        new = np.ones(len(hit), bool)
        new[1:] = np.diff(hit) > 1
        begin = np.maximum.accumulate(np.where(new, hit, 0))
        kept = (hit - begin) % 2 == 0
        hit, at_slot = hit[kept], at_slot[kept]
        used = np.zeros(1 << _SLOTS, bool)
        used[at_slot] = True
        chosen = table[used]
        which = (np.cumsum(used) - 1)[at_slot]
        base = first_rule + sum(map(len, rules))
        pair = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = np.concatenate([np.ones(first_rule, np.uint32), *lengths])
        rules.append(pair)
        lengths.append((known[pair[:, 0]] + known[pair[:, 1]]).astype(np.uint32))
        seq[hit] = (base + which).astype(np.uint32)
        last[hit] = last[hit + 1]
        changed = np.zeros(len(seq), bool)
        changed[active] = changed[hit] = changed[hit[hit > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        ends = ends - np.searchsorted(hit + 1, ends)
        seq, last, changed = seq[keep], last[keep], changed[keep]
        active = np.flatnonzero(changed & ~last)
    none = np.zeros((0, 2), np.uint32)
    return seq, ends, np.concatenate([none, *rules]), np.concatenate([none[:, 0], *lengths])


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for: each pass replaces all nonterminals by their pairs."""
    while len(symbols):
        more = symbols >= first_rule
        if not more.any():
            break
        width = 1 + more.astype(np.int64)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[at[~more]] = symbols[~more]
        pair = rules[symbols[more] - first_rule]
        out[at[more]], out[at[more] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def _expanded(symbols: np.ndarray, more: np.ndarray, length: np.ndarray, at: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """expand(symbols, ...), by one lookup in a table of what each nonterminal stands for, unless that is the longer one.
    more: which symbols are nonterminals; length: the ids that each symbol stands for, at: their sums."""
    if lengths.sum() > length.sum():
        return expand(symbols, rules, first_rule)
    table = expand(np.arange(first_rule, first_rule + len(rules), dtype=np.uint32), rules, first_rule)
    begin = np.arange(len(table), len(table) + len(symbols))  # ids stand for themselves
    begin[more] = (np.cumsum(lengths) - lengths)[symbols[more] - first_rule]
    begin -= at - length
    return np.concatenate([table, symbols])[np.repeat(begin, length) + np.arange(length.sum())]


def encoded(documents: DataFrame, tokenizer_path: str, end_id: int = 0, vocabulary: int = 1 << 16, docs_per_shard: int = 4096, block: int = 1 << 20) -> DataFrame:
    """The file's rows (BLOCK) of documents(doc_id, text, ...)."""
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    shards = documents.select("doc_id").count() // docs_per_shard + 1
    # the hash of the text parts rows of one doc_id, of which there may be very many
    docs = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def blocks(batches):
        encoder, shard, number = _tokens.tokenizer(tokenizer_path, "bytes"), TaskContext.get().partitionId(), 0
        ids, names, held = [], [], 0

        def row():
            flat, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
            symbols, symbol_ends, rules, lengths = compress(flat, ends, vocabulary)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": number, "n_ids": len(flat), "doc_id": names, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(), "doc_symbols": np.diff(symbol_ends, prepend=0).tolist(), "first_rule": vocabulary}], schema=arrow)

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids.append(np.append(x, np.uint32(end_id)))
                names.append(name)
                held += len(x) + 1
                if held >= block:
                    yield row()
                    ids, names, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    i, longs, raw = pa.int64(), pa.list_(pa.int64()), pa.binary()
    arrow = pa.schema([("shard", i), ("block", i), ("n_ids", i), ("doc_id", longs), ("rules", raw), ("lengths", raw), ("symbols", raw), ("doc_symbols", longs), ("first_rule", i)])
    return docs.mapInArrow(blocks, BLOCK)


def decode_documents(block: dict, which=None) -> list[np.ndarray]:
    """The ids of a block's documents, or of those at the given places, without expanding the others."""
    rules = np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    symbols = np.frombuffer(block["symbols"], "<u4")
    ends = np.cumsum(block["doc_symbols"])
    if which is not None:
        return [expand(symbols[ends[k] - block["doc_symbols"][k] : ends[k]], rules, block["first_rule"]) for k in which]
    length = np.ones(len(symbols), np.int64)
    more = symbols >= block["first_rule"]
    lengths = np.frombuffer(block["lengths"], "<u4").astype(np.int64)
    length[more] = lengths[symbols[more] - block["first_rule"]]
    at = np.cumsum(length)
    return np.split(_expanded(symbols, more, length, at, rules, lengths, block["first_rule"]), at[ends - 1][:-1])


def index_of(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a file that was read."""

    def documents(batches):
        for batch in batches:
            for b in batch.to_pylist():
                got = decode_documents(b)
                n = np.array([len(x) for x in got], np.int64)
                cols = [[b["shard"]] * len(n), [b["block"]] * len(n), b["doc_id"], np.cumsum(n) - n, n, [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    heads = file.select("shard", "block", "n_ids")
    # sums of shards within a group, and of groups, of which there are few
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("g", F.floor(F.col("shard") / F.lit(GROUP)))
    groups = shards.groupBy("g").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(W.orderBy("g")) - F.col("m"))
    inner = F.sum("n").over(W.partitionBy("g").orderBy("shard")) - F.col("n")
    shards = shards.withColumn("inner", inner).join(F.broadcast(groups.select("g", "before")), "g").withColumn("base", F.col("before") + F.col("inner"))
    within = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    bases = heads.withColumn("within", within).join(shards.select("shard", "base"), "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("base"))
    read = file.mapInArrow(documents, "shard long, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(_shared.broadcast_if_small(bases), ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(documents: DataFrame, tokenizer_path: str, path: str, **how) -> None:
    encoded(documents, tokenizer_path, **how).write.parquet(path)


def op8_repair_token_files(spark, sf_dir):
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return index_of(_shared.stored(encoded(documents, public_tokenizers.path("byte_bpe_50k.json")), "tokens"))
