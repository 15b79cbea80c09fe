"""String columns: white space, titles, code blocks, greedy splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def title(c: Column) -> Column:
    return F.initcap(c)


def has_code(c: Column) -> Column:
    return c.contains("`") | c.contains("<code>")


def stamp(ts: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("]"))


def fenced(c: Column) -> Column:
    """Fenced blocks as array<struct<language, code, raw>>."""
    pattern = r"(?sU)```(\w+)?\n(.*?)```"
    part = lambda k: F.regexp_extract_all(c, F.lit(pattern), F.lit(k))
    return F.zip_with(F.arrays_zip(part(1).alias("l"), part(2).alias("c")), part(0), lambda x, raw: F.struct(F.when(x["l"] == "", "text").otherwise(x["l"]).alias("language"), x["c"].alias("code"), raw.alias("raw")))


def inline(c: Column, longer_than: int = 20) -> Column:
    """Inline blocks of more characters than longer_than."""
    part = lambda k: F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(k))
    both = F.zip_with(part(1), part(0), lambda code, raw: F.struct(F.lit("text").alias("language"), code.alias("code"), raw.alias("raw")))
    return F.filter(both, lambda x: F.length(x["code"]) > longer_than)


def split_greedy(c: Column, limit: int) -> Column:
    """Pieces of at most `limit` characters: whole paragraphs where all fit, else whole words; a longer word stays whole."""
    paragraphs = F.split(c, "\n\n")
    by_words = (F.size(paragraphs) == 1) | F.exists(paragraphs, lambda p: F.length(p) > limit)
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")

    def packed(parts: Column, glue: str) -> Column:
        """Lengths are folded to the places where pieces begin; strings are joined once a piece."""
        start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("used"), F.lit(0).alias("i"))

        def step(acc: Column, x: Column) -> Column:
            n = F.length(x) + len(glue)
            fits = acc["used"] + n <= limit
            return F.struct(F.when(fits, acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["i"]))).alias("cuts"), (F.when(fits, acc["used"]).otherwise(0) + n).alias("used"), (acc["i"] + 1).alias("i"))

        def pieces(x: Column) -> Column:
            bounds = F.zip_with(F.concat(F.array(F.lit(0)), x["cuts"]), F.concat(x["cuts"], F.array(F.size(x["parts"]))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return F.transform(bounds, lambda b: strip(F.array_join(F.slice(x["parts"], b["a"] + 1, b["b"] - b["a"]), glue)))

        # transforms of one element keep what the lambdas share from being made anew
        cut = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), F.aggregate(p, start, step, lambda acc: acc["cuts"]).alias("cuts")))
        return F.filter(F.flatten(F.transform(cut, pieces)), lambda p: p != "")

    return F.when(by_words, packed(words, " ")).otherwise(packed(paragraphs, "\n\n"))
