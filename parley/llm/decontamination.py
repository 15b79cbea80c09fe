"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

1. The lengths of the posting lists of all terms of the benchmark are counted over all documents; a window (n
   consecutive item words) with a term of an empty list occurs nowhere.
2. The lists of each window's rarest terms are stored: (term, document, position), and a row with each document's
   number of words, so that the texts are cut into words twice and no more.
3. Lists are intersected from the rarest term on, positions being shifted back by the term's place in the
   window, so that what is left after each step are (document, window, start) triples.
4. The documents that are left (few) are read once more and the whole window is compared word by word.

In the index a term is the 64-bit hash of its word: words that share one can only add candidates, which step 4 drops.
Benchmark-sized tables are broadcast after a count, else the joins shuffle. Equal windows are looked up once.
Hits of one document are merged as intervals, so a hot passage gives rows in proportion to its occurrences.

Defined cases: null and empty texts have no words (and no hits); an item of fewer words than n, but not none,
is one window; repeated rows are each judged on their own text; a null doc_id is an id like others; items with
one id are one item; without items or documents nothing is hit; a text may have any length, as its postings are rows;
terms of equally long lists are ranked by the word, then by place; further columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no word: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def pieces(text: Column) -> Column:
    """The words as they stand; an empty one is first or last where the text begins or ends with a gap (or is empty)."""
    return F.split(F.coalesce(text, F.lit("")), GAP + "+")


def edges(text: Column) -> tuple[Column, Column]:
    """How many empty pieces (0 or 1) are first and last; of an empty text the only one is first."""
    t = F.coalesce(text, F.lit(""))
    at = lambda i: F.substring(t, i, 1).rlike(GAP)
    return F.when((t == "") | at(1), 1).otherwise(0), F.when((t != "") & at(-1), 1).otherwise(0)


def folded(word: Column) -> Column:
    """A-Z as a-z; the quick form is for words of ASCII alone, as it would change other letters too."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.transform(pieces(text), folded), lambda x: x != "")


def term_of(word: Column) -> Column:
    return F.xxhash64(folded(word))


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(win, len, terms, items): each different window, with the ids of its items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(n - 1)))).alias("s"))
    cut = starts.select("item_id", F.slice("w", F.col("s"), n).alias("terms"))
    return cut.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(F.xxhash64("terms").alias("win"), F.size("terms").alias("len"), "terms", "items")


class PositionalIndex:
    """Posting lists (term, doc_id, th, pos), pos from 0, of chosen terms over all documents; th is the hash of
    the text, which tells rows of one doc_id apart. sizes: (doc_id, th, n_words) of every row of documents."""

    def __init__(self, documents: DataFrame, terms: DataFrame, scratch: _shared.Scratch):
        """terms: one column, term, of different terms, of a checked size if it is to be broadcast."""
        text, c = F.col("text"), F.col
        first, last = edges(text)
        # a null piece ends each text: its place gives the number of words
        cut = F.posexplode_outer(F.concat(pieces(text), F.array(F.lit(None).cast("string")))).alias("pos", "piece")
        places = documents.select("doc_id", F.xxhash64("text").alias("th"), first.alias("first"), last.alias("last"), cut)
        end = c("piece").isNull()
        places = places.select("doc_id", "th", F.when(end, c("pos") - c("first") - c("last")).otherwise(c("pos") - c("first")).alias("pos"), F.when(end, F.lit(0).cast("long")).otherwise(term_of(c("piece"))).alias("term"), end.alias("end"))
        ends = documents.sparkSession.range(1).select(F.col("id").alias("term"))
        found = places.join(F.broadcast(terms.union(ends).distinct()) if _shared.is_small(terms) else terms.union(ends).distinct(), "term")
        stored = scratch.stored(found.select("term", "doc_id", "th", "pos", "end"), "postings")
        self.postings = stored.where(~c("end")).drop("end")
        self.sizes = stored.where("end").select("doc_id", "th", c("pos").cast("long").alias("n_words"))

    @staticmethod
    def lengths(documents: DataFrame, terms: DataFrame) -> DataFrame:
        """(term, n): the posting list lengths of the given terms that occur at all."""
        return documents.select(F.explode_outer(pieces(F.col("text"))).alias("piece")).select(term_of(F.col("piece")).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))

    def phrases(self, ranked: DataFrame, depth: int) -> DataFrame:
        """(doc_id, th, win, start) where the `depth` rarest terms of a window stand at their places.
        ranked: (win, rank from 1, off, term), all of a window's ranks up to depth or its length."""
        found = None
        for r in range(1, depth + 1):
            terms = _shared.broadcast_if_small(ranked.where(F.col("rank") == r).select("win", "off", "term"))
            if found is None:
                found = self.postings.join(terms, "term").where("pos >= off").select("doc_id", "th", "win", (F.col("pos") - F.col("off")).alias("start"))
            else:
                asked = found.join(terms, "win", "left").select("doc_id", "th", "win", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
                short = asked.where("term IS NULL").select("doc_id", "th", "win", "start")
                here = self.postings.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("pos").alias("p"), F.col("term").alias("t"))
                long = asked.join(here, (F.col("th") == F.col("h")) & (F.col("pos") == F.col("p")) & (F.col("term") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
                found = long.select("doc_id", "th", "win", "start").union(short)
        return found

    def near(self, pairs: DataFrame, gap: int) -> DataFrame:
        """(doc_id, th, first, second, pos, pos2) where two stored terms of pairs(first, second) stand at most gap words
        apart, in either order. pairs: of a checked size if they are to be broadcast."""
        # places fall into blocks of gap + 1 words; a partner is in the same block or a neighbouring one
        block = F.floor(F.col("pos") / F.lit(gap + 1))
        a = self.postings.join(pairs, F.col("term") == F.col("first")).select("doc_id", "th", "first", "second", "pos", F.explode(F.array(block - 1, block, block + 1)).alias("k"))
        b = self.postings.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("term").alias("t"), F.col("pos").alias("pos2"), block.alias("b"))
        here = (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("second") == F.col("t")) & (F.col("k") == F.col("b"))
        return a.join(b, here & (F.abs(F.col("pos") - F.col("pos2")) <= gap) & (F.col("pos") != F.col("pos2"))).select("doc_id", "th", "first", "second", "pos", "pos2")

    def proximity(self, first: str, second: str, gap: int) -> DataFrame:
        """(doc_id, th, pos, pos2) where two stored words stand at most gap words apart, in either order."""
        pair = self.postings.sparkSession.range(1).select(term_of(F.lit(first)).alias("first"), term_of(F.lit(second)).alias("second"))
        return self.near(F.broadcast(pair), gap).select("doc_id", "th", "pos", "pos2").distinct()


def occurrences(documents: DataFrame, benchmark: DataFrame, n: int = 10, depth: int = 3) -> DataFrame:
    """(doc_id, th, win, start, len, items): every place where a window of an item occurs in a document."""
    with _shared.Scratch() as scratch:
        return scratch.keep(searched(scratch, documents, benchmark, n, depth)[0])


def searched(scratch: _shared.Scratch, documents: DataFrame, benchmark: DataFrame, n: int, depth: int, gap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The occurrences, (doc_id, th, n_words) of every row, and with a gap (doc_id, th, item): the items of which the two
    rarest words of a window stand that near. All read stored tables."""
    documents = documents.select("doc_id", "text")
    every = scratch.stored(windows(benchmark, n), "windows")
    terms = every.select("win", "len", F.posexplode("terms").alias("off", "word")).select("win", "len", "off", "word", term_of(F.col("word")).alias("term"))
    lengths = scratch.stored(PositionalIndex.lengths(documents, _shared.broadcast_if_small(terms.select("term").distinct(), _shared.BROADCAST_LONGS)), "lengths")
    by = W.partitionBy("win")
    ranked = terms.join(_shared.broadcast_if_small(lengths), "term").withColumn("there", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("n", "word", "off"))).where("there = len").where(F.col("rank") <= depth)
    ranked = scratch.stored(ranked.select("win", "rank", "off", "term"), "ranked")
    index = PositionalIndex(documents, ranked.select("term").distinct(), scratch)
    found = scratch.stored(index.phrases(ranked, depth), "found")
    where = found.join(_shared.broadcast_if_small(every.select("win", "len"), 100_000), "win").groupBy("doc_id", "th").agg(F.collect_set(F.struct("win", "start", "len")).alias("at"))
    where = scratch.stored(where.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "at"), "where")
    ids = _shared.broadcast_if_small(where.select("d", "h").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    left = documents.select("doc_id", "text", F.xxhash64("text").alias("th")).join(ids, same, "left_semi").select("doc_id", "th", words(F.col("text")).alias("w"))
    cut = F.transform("at", lambda x: F.struct(x["win"].alias("win"), x["start"].alias("start"), x["len"].alias("len"), F.slice("w", x["start"] + 1, x["len"]).alias("got")))
    places = left.join(where, same).select("doc_id", "th", F.explode(cut).alias("x")).select("doc_id", "th", "x.*")
    full = _shared.broadcast_if_small(every.select(F.col("win").alias("v"), "terms", "items"), 50_000)
    hits = places.join(full, (F.col("win") == F.col("v")) & (F.col("got") == F.col("terms"))).select("doc_id", "th", "win", "start", "len", "items").distinct()
    hits, near = scratch.stored(hits, "hits"), None
    if gap is not None:
        two = [ranked.where(F.col("rank") == r).select("win", F.col("term").alias(name)) for r, name in ((1, "first"), (2, "second"))]
        items = two[0].join(two[1], "win").join(every.select("win", F.explode("items").alias("item")), "win").select("first", "second", "item").distinct()
        items = scratch.stored(items, "near-items")
        pairs = _shared.broadcast_if_small(items.select("first", "second").distinct())
        near = scratch.stored(index.near(pairs, gap).select("doc_id", "th", "first", "second").distinct(), "near")
        near = near.join(_shared.broadcast_if_small(items, 100_000), ["first", "second"]).select("doc_id", "th", "item").distinct()
    return hits, index.sizes, near


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, depth: int = 3, gap: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents, and n_near: the items with a
    window of which the two rarest words stand at most gap words apart there (a proximity match, which need be no hit)."""
    with _shared.Scratch() as scratch:
        hits, sizes, near = searched(scratch, documents, benchmark, n, depth, gap)
        by = W.partitionBy("doc_id", "th").orderBy("start", "len", "win").rowsBetween(W.unboundedPreceding, -1)
        covered = hits.withColumn("past", F.coalesce(F.max(F.col("start") + F.col("len")).over(by), F.lit(0))).groupBy("doc_id", "th").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "past"))).alias("n_hit"))
        items = hits.select("doc_id", "th", F.explode("items").alias("item")).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("ids"))
        both = covered.join(items, covered.doc_id.eqNullSafe(items.doc_id) & (covered.th == items.th)).select(covered.doc_id.alias("d"), covered.th.alias("h"), "n_hit", "ids")
        both = scratch.stored(both, "both")
        near = scratch.stored(near.groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("h2")).agg(F.count("*").alias("n_near")), "near-counts")
        sizes = scratch.stored(sizes, "sizes")
        for kept in (both, near, sizes):
            scratch.keep(kept)
    out = sizes.join(_shared.broadcast_if_small(both, 20_000), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    out = out.join(_shared.broadcast_if_small(near), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("h2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, len, array_to_string(w[s:s + len - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 10) AS len, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
places AS (SELECT r, s, len, array_to_string(w[s:s + len - 1], ' ') AS k FROM (SELECT r, w, len, unnest(generate_series(1, len(w) - len + 1)) AS s FROM d, lens)),
hits AS (SELECT r, s, len, item FROM places JOIN win USING (len, k)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(s, s + len - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
p AS (SELECT r, unnest(w) AS t, unnest(generate_series(1, len(w))) AS pos FROM d),
c AS (SELECT t, count(*) AS n FROM p GROUP BY t),
wt AS (SELECT k, len, unnest(string_split(k, ' ')) AS t, unnest(generate_series(1, len)) AS off FROM (SELECT DISTINCT k, len FROM win)),
rk AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY c.n, t, off) AS rank, count(*) OVER (PARTITION BY k) AS there, len FROM wt JOIN c USING (t)),
two AS (SELECT DISTINCT a.t AS t1, b.t AS t2, win.item FROM rk a JOIN rk b ON a.k = b.k AND a.rank = 1 AND b.rank = 2 AND a.there = a.len JOIN win ON win.k = a.k),
nr AS (SELECT a.r, count(DISTINCT two.item) AS n FROM p a JOIN two ON two.t1 = a.t JOIN p b ON b.r = a.r AND b.t = two.t2 AND abs(b.pos - a.pos) <= 10 AND b.pos <> a.pos GROUP BY a.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, CAST(coalesce(nr.n, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN nr USING (r)
"""


def op10_positional_index(spark, sf_dir):
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
