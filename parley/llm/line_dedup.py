"""Line dedup by an exact set-similarity join (DataFrame functions only).

A line of at least `size` words is the set of its shingles of `size` words (64-bit hashes, letters folded); a shorter one
is a single token, its words. A line goes when an earlier line (by doc_id, then place in the text) has a Jaccard
similarity of `num`/`den` or more, thus a short line when an earlier one has the same words. Blank lines stay.
 1. Lines of equal words are one class with its first line; a class is compared, not its lines.
 2. Of a line of n tokens, at most n - ceil(t*n) are not in a line that is similar. A token is in no other class if a run of
    words within it is in none; a run of LESS words less is in LESS + 1 tokens, so fewer runs than tokens tell as much. Runs
    whose hash is in the lowest SHARE of all are counted over all classes; of those that are at one place of one class only,
    no token that holds one is there twice or elsewhere, and a class with more such tokens than a similar line may lack is
    left out. (Their places are bits, modulo their number, so they can only be counted too few, and no class is lost.) Of
    the classes that are left the same is done once more, with the next BAND of runs besides.
 3. Of the classes that are left, tokens are ordered: those of one class first, then by hash, but frequent ones last and by
    rarity. The first n - ceil(t*n) + 1 are a prefix; lines that are similar share a token there, so tokens of one class need no row.
 4. Of each token that two classes have in their prefixes, all classes are compared with the earliest, and while many
    pairs are left with the next ones: with the length filter, the positional filter (the most tokens that can be
    common, given the places of the shared one and that tokens of one class are not), then by whole sets. A class with a
    match is settled.
 5. Only classes that are not settled are compared with all earlier ones that share a token, unless the number of
    tokens that their prefixes share shows that the rest can't give the overlap. No group is capped.

Defined cases: null and empty texts have no lines; a text or a line may have any length, as tokens are rows; rows that
repeat a doc_id are ordered by the hash of the text, and equal rows are one, whose lines are never matched with each
other's; a null doc_id comes first; equal lines are ties that their places decide; an empty table gives no rows; further
columns of any name are ignored (and kept by `without_repeated_lines`).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

#: The share of runs that are counted over all lines, and of those that are then counted over the lines left.
SHARE, BAND = 0.15, 0.25
#: A run has so many words less than a token.
LESS = 2
#: Tokens of so many classes are frequent and ordered by rarity.
FREQUENT = 32
#: Bits for places of a class's unshared tokens, in longs.
LONGS = 4
#: At most so many of a token's earliest classes are compared with all others, as long as the pairs left are more than
#: PAIRS times the rows that they come from.
HUBS, PAIRS = 3, 64
#: A class of more than one in so many of all lines is hot; there are at most so many of these.
HOT = 1000


def below(share: float) -> Column:
    """The hash below which so large a share of tokens is."""
    return F.lit(int((2 * share - 1) * (1 << 63)))


def odd(text: Column) -> Column:
    """That it has other white space than single blanks and ends of lines."""
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])


def plain(line: Column) -> Column:
    """Letters folded, words parted by single blanks."""
    low = F.lower(line)
    # only odd white space needs the pattern
    return F.trim(F.when(odd(line), F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def plain_lines(text: Column) -> Column:
    """The plain lines of a text, which is looked through once for odd white space and not line by line."""
    lines = split_lines(text)
    return F.when(odd(text), F.transform(lines, plain)).otherwise(F.transform(lines, lambda line: F.trim(F.lower(line))))


def parsed(line: Column) -> Column:
    """k1, k2 (hashes of the line) and w (of its words) of a plain line."""
    return F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"), F.transform(F.split(line, " "), lambda x: F.xxhash64(x)).alias("w"))


def token_at(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(size)))


def held_bits(i: Column, many: Column, less: int, w: int) -> Column:
    """The places, as bits of the w-th long, of the tokens that hold the runs i, which are `less` words shorter, of lines of
    so many tokens."""
    nothing = F.lit(0).cast("long")

    def bit(j: Column) -> Column:
        own = (j >= 0) & (j < many) & (F.shiftright(j, 6).bitwiseAND(F.lit(LONGS - 1)) == w)
        return F.when(own, F.call_function("shiftleft", F.lit(1).cast("long"), j.bitwiseAND(F.lit(63)))).otherwise(nothing)

    return F.bit_or(functools.reduce(lambda a, b: a.bitwiseOR(b), [bit(i - d) for d in range(less + 1)]))


def bits_set(*longs: Column) -> Column:
    return functools.reduce(lambda a, b: a + b, [F.bit_count(F.coalesce(x, F.lit(0))) for x in longs])


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def removed_lines(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, th, pos) of the lines that go; th is the hash of the text, which tells rows of one doc_id apart."""
    with _shared.Scratch() as scratch:
        return scratch.keep(_removed(scratch, documents, size, num, den))


def _removed(scratch: _shared.Scratch, documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    c, key, less = F.col, ["k1", "k2"], min(LESS, size - 1)
    th = F.xxhash64("text").alias("th")
    spare = lambda n: n - F.ceil(n * F.lit(num) / F.lit(den)).cast("int")  # noqa: E731  tokens that a similar line may lack

    # a row for each line (head) and for each of its runs that is counted; lines are parsed inside the generator, and its
    # outer form is used, as the optimizer would else parse them twice
    cut = documents.select("doc_id", th, F.posexplode_outer(F.transform(plain_lines(c("text")), parsed)).alias("pos", "x"))
    cut = cut.select("doc_id", "th", "pos", "x.*").where((F.size("w") > 1) | (F.get("w", F.lit(0)) != F.xxhash64(F.lit(""))))
    cut = cut.withColumn("many", F.size("w") - F.lit(size - 1))
    rows = cut.select("*", F.explode(F.sequence(F.lit(0), F.greatest(c("many") - 1 + less, F.lit(0)))).alias("i"))
    run = F.when(c("many") > 0, token_at(c("w"), c("i"), size - less))
    # a class is known by k1 in rows of runs, and what only its line needs is null in all but the first
    line = F.when(c("i") == 0, F.struct("doc_id", "th", "pos", "k2")).alias("line")
    rows = rows.select(line, "k1", "many", "i", F.when(run < below(SHARE), run).alias("run")).where("line IS NOT NULL OR run IS NOT NULL")
    counted = scratch.stored(rows, "counted", hashes=True)
    lines = counted.where("line IS NOT NULL").select("line.doc_id", "line.th", "line.pos", "k1", "line.k2", "many")
    lines = scratch.stored(lines, "lines", hashes=True)

    place = F.struct("doc_id", "th", "pos")
    classes = lines.groupBy(*key).agg(F.min(place).alias("o"), F.count("*").alias("copies"), F.max("many").alias("many"))
    classes = scratch.stored(classes, "line-classes", hashes=True)

    runs = counted.where("run IS NOT NULL").select("k1", "many", "i", "run")
    spot = F.xxhash64("k1", "i")
    shared = runs.groupBy("run").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y").select("run")
    shared = scratch.stored(shared, "shared", hashes=True)
    alone = runs.join(_shared.broadcast_if_small(shared, _shared.BROADCAST_LONGS), "run", "left_anti")
    alone = alone.groupBy("k1").agg(*(held_bits(c("i"), c("many"), less, w).alias(f"b{w}") for w in range(LONGS)))
    open_ = classes.where("many > 0").join(alone, "k1", "left").where(bits_set(*(c(f"b{w}") for w in range(LONGS))) <= spare(c("many")))
    open_ = scratch.stored(open_.select(*key, "o", "many", *(f"b{w}" for w in range(LONGS))), "open", hashes=True)
    scratch.drop(shared, counted)

    # whole sets of what is left, from the texts
    wanted = _shared.broadcast_if_small(open_.select(F.xxhash64("o.doc_id", "o.th", "o.pos").alias("ph")), _shared.BROADCAST_LONGS)
    one = documents.select("doc_id", th, F.posexplode_outer(split_lines(c("text"))).alias("pos", "line"))
    one = one.withColumn("ph", F.xxhash64("doc_id", "th", "pos")).join(wanted, "ph", "left_semi")
    one = one.select(place.alias("o"), F.explode_outer(F.transform(F.array(plain(c("line"))), parsed)).alias("x")).select("o", "x.*")
    words = scratch.stored(one.where(F.size("w") >= size), "words", hashes=True)
    if words.groupBy(*key).count().where("count > 1").limit(1).count():  # rows that repeat
        words = scratch.stored(words.dropDuplicates(key), "words", hashes=True)
    at = F.sequence(F.lit(0), F.size("w") - F.lit(size))
    # runs are rows here, as these are made by compiled code
    many = F.size("w") - F.lit(size - 1)
    band = words.select("k1", "w", many.alias("many"), F.explode(F.sequence(F.lit(0), many - 1 + less)).alias("i"))
    band = band.select("k1", "many", "i", token_at(c("w"), c("i"), size - less).alias("run")).where((c("run") >= below(SHARE)) & (c("run") < below(SHARE + BAND)))
    owned = band.groupBy("run").agg(F.count("*").alias("df"), F.max("k1").alias("k1"), F.max("many").alias("many"), F.max("i").alias("i")).where("df = 1")
    owned = owned.groupBy("k1").agg(*(held_bits(c("i"), c("many"), less, w).alias(f"c{w}") for w in range(LONGS)))
    both = [F.coalesce(f"b{w}", F.lit(0)).bitwiseOR(F.coalesce(f"c{w}", F.lit(0))) for w in range(LONGS)]
    over = open_.join(owned, "k1").where(bits_set(*both) > spare(c("many")))
    over = scratch.stored(over.select(*key), "over", hashes=True)
    sets = words.join(_shared.broadcast_if_small(over, _shared.BROADCAST_LONGS // 2), key, "left_anti")
    sets = scratch.stored(sets.select(*key, "o", F.array_distinct(F.transform(at, lambda i: token_at(c("w"), i, size))).alias("t")), "sets", hashes=True)
    scratch.drop(open_, over, words)

    # the order of tokens: those of one class, then those of few classes by hash, then frequent ones by rarity; only the
    # first and the last, which are few, become rows that go to their classes
    tokens = sets.select("k1", F.explode("t").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("df"), F.max("k1").alias("k1")).where((c("df") == 1) | (c("df") >= FREQUENT))
    rarity = scratch.stored(rarity, "rarity", hashes=True)
    own = rarity.where("df = 1").groupBy("k1").agg(F.collect_set("token").alias("own"))
    often = rarity.where("df > 1").select("token", "df")
    # each token is there once, so a table of a task's tokens is small, and neither side needs sorting
    often = F.broadcast(often) if _shared.is_small(often) else often.hint("shuffle_hash")
    often = tokens.join(often, "token").groupBy("k1").agg(F.array_sort(F.collect_set(F.struct("df", "token")))["token"].alias("often"))
    none = F.array().cast("array<long>")
    known = sets.join(own, "k1", "left").join(often, "k1", "left").select(*key, "o", "t", F.coalesce("own", none).alias("own"), F.coalesce("often", none).alias("often"))
    known = known.select(*key, "o", F.size("t").alias("n"), F.concat(F.array_except(F.sort_array("t"), F.concat("own", "often")), F.array_intersect("often", "t")).alias("shared"))
    # tokens of one class come first in the order, so that the prefix goes on with the others; i: those before it that can
    # be common, left: it and all that follow
    common = F.size("shared")
    members = known.withColumn("common", common).select(*key, "o", "n", "common", F.posexplode(F.slice("shared", F.lit(1), F.greatest(spare(c("n")) + 1 - (c("n") - common), F.lit(0)))).alias("i", "token"))
    members = members.select(*key, "o", "n", "i", (c("common") - c("i")).alias("left"), "token")
    members = scratch.stored(members, "members", hashes=True)
    scratch.drop(rarity)
    several = scratch.stored(members.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "several", hashes=True)
    members = scratch.stored(members.join(_shared.broadcast_if_small(several, _shared.BROADCAST_LONGS // 2), "token"), "members", hashes=True)
    early = members.select("token", c("k1").alias("e1"), c("k2").alias("e2"), c("o").alias("eo"), c("n").alias("m"), c("i").alias("j"), c("left").alias("after"))

    def candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """Pairs that share a token, by the length and the positional filter."""
        most = F.least("i", "j") + F.least("left", "after")
        may = (den * F.least("n", "m") >= num * F.greatest("n", "m")) & ((num + den) * F.least(most, "n", "m") >= num * (c("n") + c("m")))
        return later.join(earlier, "token").where((c("eo") < c("o")) & may)

    def similar(pairs: DataFrame) -> DataFrame:
        """The classes (k1, k2) that match their earlier partner (e1, e2)."""
        pairs = scratch.stored(pairs, "line-pairs", hashes=True)
        a = sets.select(*key, "t").join(_shared.broadcast_if_small(pairs), key)
        b = sets.select(c("k1").alias("e1"), c("k2").alias("e2"), c("t").alias("s"))
        both = F.size(F.array_intersect("t", "s"))
        return a.join(b, ["e1", "e2"]).where(den * both >= num * (F.size("t") + F.size("s") - both)).select(*key).distinct()

    total, settled, open_, hubs = members.count(), [], members, None
    for _ in range(HUBS):
        # of each token the next class; the first one has none before it
        rest = early if hubs is None else early.join(hubs.select("token", c("eo").alias("last")), "token").where("eo > last")
        hubs = scratch.stored(rest.groupBy("token").agg(F.min(F.struct("eo", "e1", "e2", "m", "j", "after")).alias("hub")).select("token", "hub.*"), "hubs", hashes=True)
        settled.append(scratch.stored(similar(candidates(open_, hubs).select(*key, "e1", "e2").distinct()), "settled", hashes=True))
        open_ = scratch.stored(open_.join(_shared.broadcast_if_small(settled[-1]), key, "left_anti"), "open", hashes=True)
        if (open_.agg(F.sum("df")).first()[0] or 0) <= PAIRS * total:
            break
    # beyond the tokens that two prefixes share, only the rest of one of the lines can be common
    later = candidates(open_, early).groupBy(*key, "e1", "e2").agg(F.count("*").alias("both"), F.min("n").alias("n"), F.min("m").alias("m"))
    later = later.where((num + den) * (c("both") + F.ceil(F.greatest("n", "m") * F.lit(num) / F.lit(den)) - 1) >= num * (c("n") + c("m")))
    settled = functools.reduce(DataFrame.union, settled)
    gone = settled.union(similar(later.select(*key, "e1", "e2"))).withColumn("all", F.lit(True))
    gone = classes.join(gone, key, "left").where("copies > 1 or all").select(*key, "o", "copies", F.coalesce("all", F.lit(False)).alias("all"))
    gone = scratch.stored(gone, "gone", hashes=True)
    # lines of hot classes stay where they are; the others are dealt by class
    is_hot = c("copies") > lines.count() / HOT
    hot, found = F.broadcast(gone.where(is_hot).drop("copies")), lines.select("doc_id", "th", "pos", *key)
    out = found.join(hot.select(*key), key, "left_anti").join(gone.where(~is_hot).drop("copies"), key).unionByName(found.join(hot, key))
    return scratch.stored(out.where(c("all") | ~place.eqNullSafe(c("o"))).select("doc_id", "th", "pos"), "removed-lines")


def _with_removed(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """row (a struct of all columns) and gone (places, null if none go) of every row of documents."""
    gone = removed.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    rows = documents.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("h")), "left").select("row", "gone")


def without_repeated_lines(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents with the lines cut from text; a document of which only blanks are left goes."""
    both = _with_removed(documents, removed_lines(documents, size, num, den))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    out = both.withColumn("row", F.col("row").withField("text", text)).where(F.col("gone").isNull() | F.col("row.text").rlike(r"\S"))
    return out.select("row.*")


def line_report(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (places from 0, comma-joined) of every row of documents."""
    gone = removed_lines(documents, size, num, den).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(1)).cast("long")
    # counted inside a generator, so that the count and not the text goes to the join
    docs = documents.select("doc_id", F.explode_outer(F.array(F.struct(F.xxhash64("text").alias("th"), n_lines.alias("n_lines")))).alias("x")).select("doc_id", "x.*")
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, list_filter(regexp_split_to_array(lower(ls[i]), '\s+'), lambda x: x <> '') AS w, len(ls) AS n_lines
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT doc_id, pos, array_to_string(w, ' ') AS k, w, row_number() OVER (ORDER BY doc_id, pos) AS o FROM l WHERE len(w) > 0),
c AS (SELECT k, min(o) AS o, any_value(w) AS w FROM k GROUP BY k),
t AS (SELECT DISTINCT o, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM c),
n AS (SELECT o, count(*) AS n FROM t GROUP BY o),
p AS (SELECT a.o AS a, b.o AS b, count(*) AS cc FROM t a JOIN t b ON a.t = b.t AND a.o > b.o GROUP BY 1, 2),
gone AS (SELECT DISTINCT a FROM p JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE 100 * cc >= 80 * (x.n + y.n - cc)),
r AS (SELECT k.doc_id, k.pos FROM k JOIN c ON c.k = k.k WHERE k.o <> c.o OR k.o IN (SELECT a FROM gone)),
per AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM r GROUP BY doc_id)
SELECT DISTINCT l.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(per.n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM l LEFT JOIN per USING (doc_id)
"""


def op5_set_similarity_line_dedup(spark, sf_dir):
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
