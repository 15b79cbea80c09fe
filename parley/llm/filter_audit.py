"""Filter interaction audit: what each of five filters removes in every order of applying them (an RDD routed by
fingerprints).

1. A task reads texts, finds which of the filters A to D each fails, and keeps one row of the copies that it meets: the
   one of least id. Others fail E already and are sent on without their text, spread evenly; so a group of copies,
   however large, reaches its owner as a row a task. What a task holds is bounded (`HELD` bytes); what does not fit
   is sent earlier.
2. Rows with a text are partitioned and sorted by the xxhash of the text. An owner walks over its hashes in order: a
   hash has a chain of entries, each a full text and the least id met with it. A row whose id is not the least of its
   entry is emitted as failing E; the least follows when its hash is over. Texts of one hash are told apart by their
   characters, and only one hash's chain is held at a time.
3. Labels are joined to (doc_id, part, mask), never to texts.
4. combineByKey adds up, for each part, three vectors over the 32 masks: documents, those of quality 1, toxic ones.
   All rows of the result follow from these.

Defined cases: null text is empty; null lang is the part ''; a null doc_id is smaller than none and no other is smaller
than it, so such rows never fail E nor make others fail; rows that repeat both id and text do not fail by each other;
a document is good (toxic) if any label row of its id says so; texts of any length are compared whole; an empty table
has no parts and so no rows; further columns are ignored. The order of a task's input must not change when the task is
run again, which a scan of files keeps.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")
#: Bytes of text that a task keeps to meet copies of, and that an owner gets before copies are left out.
HELD, OWNED = 32 << 20, 128 << 20

_CAPITALS = bytes(range(0x41, 0x5B))
_SIGNS = re.compile(rb"[#$%&*|]")


def own_failures(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails, as bits; raw: its UTF-8."""
    words = raw.split()  # of bytes: at runs of space and the controls from tab to carriage return
    n = len(words)
    fails = (n < 100, 100 * len(set(words)) < 80 * n, 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(text), _SIGNS.search(raw) is not None)
    return sum(1 << k for k, x in enumerate(fails) if x)


class Entry:
    """A full text (by its holder), the least id met with it, and how many rows of that id there are of each part."""

    __slots__ = ("text", "mask", "least", "parts")

    def __init__(self, text: str, mask: int, doc_id: int, part: str, n: int = 1):
        self.text, self.mask, self.least, self.parts = text, mask, doc_id, Counter({part: n})

    def met(self, doc_id: int, part: str, n: int = 1):
        """Takes rows of this text in; gives those, (doc_id, part, n), that are now known not to be of the least id."""
        if doc_id > self.least:
            return [(doc_id, part, n)]
        if doc_id == self.least:
            self.parts[part] += n
            return []
        gone = [(self.least, p, k) for p, k in self.parts.items()]
        self.least, self.parts = doc_id, Counter({part: n})
        return gone


def routed(held: int = HELD):
    """The map side: keyed rows (hash, (text or None, doc_id, part, mask, n))."""

    def rows(documents):
        import xxhash

        entries: dict[str, Entry] = {}
        size = sent_on = 0

        def spread(doc_id, part, mask, n):
            nonlocal sent_on
            sent_on += 1  # ids may all be null
            return xxhash.xxh64_intdigest(b"%d" % sent_on), (None, doc_id, part, mask, n)

        def sent():
            for e in entries.values():
                h = xxhash.xxh64_intdigest(e.text.encode())
                for part, n in e.parts.items():
                    yield h, (e.text, e.least, part, e.mask, n)

        for doc_id, part, text in documents:
            text, part = text or "", part or ""
            entry = entries.get(text)
            if entry is not None and doc_id is not None:
                for d, p, n in entry.met(doc_id, part):
                    yield spread(d, p, entry.mask | REPEATED, n)
                continue
            raw = text.encode()
            mask = entry.mask if entry is not None else own_failures(text, raw)
            if doc_id is None:
                yield spread(None, part, mask, 1)
                continue
            if entries and size + len(raw) > held:
                yield from sent()
                entries.clear()
                size = 0
            entries[text] = Entry(text, mask, doc_id, part)
            size += len(raw)
        yield from sent()

    return rows


def owned(rows):
    """The owner's side, over rows sorted by hash: (doc_id, part, mask, n)."""
    chain: list[Entry] = []
    for h, group in itertools.groupby(rows, key=lambda x: x[0]):
        chain.clear()
        for _, (text, doc_id, part, mask, n) in group:
            if text is None:
                yield doc_id, part, mask, n
                continue
            entry = next((e for e in chain if e.text == text), None)
            if entry is None:
                chain.append(Entry(text, mask, doc_id, part, n))
            else:
                for d, p, k in entry.met(doc_id, part, n):
                    yield d, p, entry.mask | REPEATED, k
        for e in chain:
            for part, n in e.parts.items():
                yield e.least, part, e.mask, n


def failures(documents: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, part, mask (bit k: fails the k-th of ABCDE), n (equal rows) of all documents(doc_id, lang, text, ...)."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, rows = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // OWNED), rows.rdd
    own = rows.mapPartitions(routed(held)).repartitionAndSortWithinPartitions(parts, lambda h: h % parts).mapPartitions(owned)
    return spark.createDataFrame(own, "doc_id long, part string, mask int, n long", verifySchema=False)


def _added(vectors, row):
    mask, n, good, toxic = row
    vectors[:, mask] += (n, n * good, n * toxic)
    return vectors


def mask_counts(failed: DataFrame, labels: DataFrame):
    """An RDD of (part, vectors): by mask the documents, those of quality 1, and the toxic ones."""
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = failed.join(said.where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)"), "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    create = lambda row: _added(np.zeros((3, 32), np.int64), row)
    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(create, _added, lambda a, b: a + b)


def orders_of(part: str, vectors: np.ndarray):
    """The rows of one part: every order of the filters, step by step."""
    count, good, toxic = vectors
    masks = np.arange(32)
    has = [(masks >> k & 1).astype(bool) for k in range(5)]
    # in 120 / j of the orders a filter is the first of the j that a document fails
    shapley = [int((count[h] * (120 // np.bitwise_count(masks[h]).astype(np.int64))).sum()) for h in has]
    for order in itertools.permutations(range(5)):
        name, before = "".join(LETTERS[k] for k in order), np.zeros(32, bool)
        for step, k in enumerate(order, 1):
            here = has[k] & ~before
            redundant, before = has[k] & before, before | has[k]
            yield part, name, step, int(count[~before].sum()), int(count[here].sum()), int(count[redundant].sum()), int(count[1 << k]), int(good[here].sum()), int(toxic[here].sum()), shapley[k]


def filter_audit(documents: DataFrame, labels: DataFrame, held: int = HELD) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = mask_counts(failures(documents, held), labels).flatMap(lambda x: orders_of(*x))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return documents.sparkSession.createDataFrame(rows, schema, verifySchema=False)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
m AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, f),
l AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, o, step, n, good, toxic, f[o[step]] AS fails, list_bool_or(list_transform(o[1:step - 1], lambda k: f[k])) AS earlier, len(list_filter(f, lambda x: x)) AS many FROM m, s),
a AS (SELECT part, o, step, sum(CASE WHEN NOT fails AND NOT coalesce(earlier, false) THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT coalesce(earlier, false) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND coalesce(earlier, false) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails AND NOT coalesce(earlier, false) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT coalesce(earlier, false) THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM a
"""


def op13_filter_audit(spark, sf_dir):
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
