"""Cost-balanced packing of tokenised documents into sequences of one capacity.

Each task packs its own documents, so nothing is shuffled and a lost task is simply run again. It gathers a
window of documents (about `window` tokens; more documents are only a longer run, never more memory), then
 1. cuts off whole sequences from documents of a capacity or more;
 2. estimates the cost of the remainders as tokens + tokens**2 / capacity (attention within a document is
    quadratic), and gives them, in descending order, to the sequence of lowest cost that has room, among as many
    sequences as the window's tokens can fill;
 3. cuts the remainders that found no room into the places left, lowest cost first, so that every one of these
    sequences is full; less than one sequence's tokens go on to the next window.
What a task has left at its end (less than a sequence) goes to sequences whose lengths are powers of two, which
need no padding.

Defined cases: null text is empty, so its document is the end id alone; a text may have any length, and its whole
sequences leave as they are cut; repeated rows are documents of their own; remainders of equal length (ties) are taken in
the order in which they came, sequences of equal cost from the first; a null doc_id stays null; without rows there are no
pieces; further columns of any name are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs what is added; pieces() gives and forgets (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: list[tuple] = []  # (doc, start, ids, doc_tokens)
        self.tokens, self.done = 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for s in range(0, whole, self.capacity):
            self.done.append((doc, s, ids[s : s + self.capacity], len(ids), self.next_id, 0))
            self.next_id += 1
        if whole < len(ids):
            self.waiting.append((doc, whole, ids[whole:], len(ids)))
            self.tokens += len(ids) - whole

    def flush(self, last: bool = False) -> None:
        sizes = [self.capacity] * (self.tokens // self.capacity)
        if last and (rest := self.tokens % self.capacity):
            sizes += [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]
        room, used, cost = np.array(sizes, np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        over = []

        def put(piece: tuple, k: int) -> None:
            n = len(piece[2])
            self.done.append((*piece, self.next_id + k, int(used[k])))
            used[k] += n
            room[k] -= n
            cost[k] += n + n * n / self.capacity

        for piece in sorted(self.waiting, key=lambda p: -len(p[2])):
            fits = np.flatnonzero(room >= len(piece[2]))
            if len(fits):
                put(piece, int(fits[np.argmin(cost[fits])]))
            else:
                over.append(piece)
        self.waiting = []
        free = iter(np.flatnonzero(room)[np.argsort(cost[room > 0], kind="stable")].tolist())
        k = next(free, None)
        for doc, start, ids, n in over:
            while len(ids) and k is not None:
                cut = int(min(len(ids), room[k]))
                put((doc, start, ids[:cut], n), k)
                start, ids = start + cut, ids[cut:]
                if not room[k]:
                    k = next(free, None)
            if len(ids):
                self.waiting.append((doc, start, ids, n))
        self.next_id += len(sizes)
        self.tokens = sum(len(p[2]) for p in self.waiting)

    def pieces(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, window: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """The pieces of documents(doc_id, text, ...): SCHEMA, with the ids themselves as binary if wanted."""
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def packed(batches):
        encoder = _tokens.tokenizer(tokenizer_path, "words")
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def rows():
            found = packer.pieces()
            raw = [p[2].astype("<u4").tobytes() for p in found]
            cols = [[p[0] for p in found], [p[1] for p in found], [len(p[2]) for p in found], [zlib.crc32(r) for r in raw], [p[3] for p in found], [p[4] for p in found], [p[5] for p in found]]
            cols = [pa.array(c, pa.int64()) for c in cols] + ([pa.array(raw, pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
                if packer.tokens >= window:
                    packer.flush()
                    yield rows()
                elif len(packer.done) >= 1024:
                    yield rows()
        packer.flush(last=True)
        yield rows()

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(packed, schema)


def op6_cost_balanced_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
