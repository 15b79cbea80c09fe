"""Reply threads: the root, depth and path of every message, from the ids of the messages that they answer.

Pointers are doubled: a message's pointer leads to its parent and its way holds the ids on the way there; in a round every
way takes on the way of the message to which its pointer leads. So a thread of n messages, however deep, is whole after
log2(n) rounds of one join, and rounds end when no pointer is left, or when ways are longer than any scope has messages.
Ways hold `HOP` ids at most, later rounds take on depths and roots alone. A longer path is put together at the end, of the way
to the next message above whose depth is divisible by HOP and of that message's path. The paths of those messages, one in HOP of
a thread, are made of their ways, in the order in which they are each other's answers: that is a table of threads again. So
paths are whole, and what is shuffled is about HOP ids a message and the whole paths of one message in HOP; what grows with the
square of a deep thread besides is the result.
Joins are sorted merges: ids and ways are small as files and many times that in memory, so a broadcast that is planned by the
size of files would take them all through the driver.

Defined cases: a message without a parent, or whose parent isn't in its scope (`missing_parent`), is a root of depth 0; of
messages that share a scope and uuid the first by order counts as the parent of answers, and each is a row of its
own; a message that is on a cycle, or under one, is `cyclic` and has no root, depth and path; a null uuid is answered by
none and can't name a root or a path's entry; a null scope is a scope; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a way that rounds of joins send on, a power of two; it bounds their rows and not the paths.
HOP = 1024


def reply_threads(messages: DataFrame, saved: Callable[[DataFrame], DataFrame], scope: str = "file_path", uuid: str = "uuid", parent: str = "parent_uuid", order: str = "line_no", nearest: int | None = None, hop: int = HOP) -> DataFrame:
    """messages with root, depth, path (uuids from the root to the message; of them the nearest to the message, if a caller
    asks for so many only), missing_parent and cyclic. saved: writes a table and reads it again, once for each round."""
    known = messages.where(F.col(uuid).isNotNull()).groupBy(F.col(scope).alias("s"), F.col(uuid).alias("u"))
    known = saved(known.agg(F.min(F.struct(F.col(order), F.xxhash64(parent), F.col(parent).alias("p")))["p"].alias("p")))
    longest = known.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    there = known.select(F.col("s").alias("s2"), F.col("u").alias("u2"))
    ways = known.join(there.hint("merge"), F.col("s").eqNullSafe(F.col("s2")) & (F.col("p") == F.col("u2")), "left")
    # path: the message and those above it, the pointer's own not among them
    ways = saved(ways.select("s", "u", F.col("u2").alias("to"), F.col("u2").isNotNull().cast("long").alias("depth"), F.array("u").alias("path"), F.when(F.col("u2").isNull(), F.col("u")).alias("root")))
    covered, near = 1, None
    while covered < longest and ways.where("to IS NOT NULL").limit(1).count():
        if covered == hop:
            near, ways = ways.select(F.col("s").alias("s3"), F.col("u").alias("u3"), F.col("to").alias("above"), "path"), ways.drop("path")
        far = ways.select(F.col("s").alias("s2"), F.col("u").alias("u2"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"), *([] if near is not None else [F.col("path").alias("on")]))
        both = ways.join(far.hint("merge"), F.col("s").eqNullSafe(F.col("s2")) & (F.col("to") == F.col("u2")), "left")
        path = [] if near is not None else [F.concat("path", F.coalesce("on", F.array().cast("array<string>"))).alias("path")]
        ways = saved(both.select("s", "u", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("root", "top").alias("root"), *path))
        covered *= 2
    if near is not None:
        ways = ways.join(near.hint("merge"), F.col("s").eqNullSafe(F.col("s3")) & (F.col("u") == F.col("u3")))
    joined = near is not None and (nearest is None or nearest > hop)
    long = F.col("root").isNotNull() & (F.col("depth") >= hop) if joined else F.lit(False)
    # of a long path the messages below the next whose depth is divisible by hop, and that one's id
    rest = (F.col("depth") % hop).cast("int")
    way = F.when(long, F.slice("path", 1, rest)).otherwise(F.col("path"))
    up = ways.select(F.col("s").alias("s2"), F.col("u").alias("u2"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), way.alias("_path"), F.when(long, F.get("path", rest)).alias("_stop"))
    out = messages.join(up.hint("merge"), F.col(scope).eqNullSafe(F.col("s2")) & (F.col(parent) == F.col("u2")), "left")
    own, found = F.array(F.col(uuid)), F.col("u2").isNotNull()
    whole = F.concat(own, "_path")
    if joined:
        stops = _stops(ways.where(long & (rest == 0)), saved, hop)
        # messages without a stop are dealt by their own ids
        out = out.join(stops.hint("merge"), F.col(scope).eqNullSafe(F.col("s4")) & (F.coalesce("_stop", F.col(uuid)) == F.col("u4")), "left")
        whole = F.concat(whole, F.when(F.col("_stop").isNull(), F.array().cast("array<string>")).otherwise(F.col("_above")))
    if nearest is not None:
        whole = F.slice(whole, 1, nearest)
    path = F.when(~found, own).when(F.col("_root").isNotNull(), F.reverse(whole))
    return out.select(
        *[messages[c] for c in messages.columns],
        F.when(~found, F.col(uuid)).otherwise(F.col("_root")).alias("root"),
        F.when(~found, F.lit(0).cast("long")).when(F.col("_root").isNotNull(), F.col("_depth") + 1).alias("depth"),
        path.alias("path"),
        (F.col(parent).isNotNull() & ~found).alias("missing_parent"),
        (found & F.col("_root").isNull()).alias("cyclic"),
    )


def _stops(ways: DataFrame, saved: Callable[[DataFrame], DataFrame], hop: int) -> DataFrame:
    """(s4, u4, _above): the ids from each of these messages, whose depths are divisible by hop, up to its root."""
    above = F.when(F.col("depth") > hop, F.col("above")).alias("p")
    threads = reply_threads(ways.select("s", "u", above, F.col("depth").alias("o"), F.col("root").alias("first")), saved, "s", "u", "p", "o", hop=hop)
    at = threads.select("s", "u", "first", F.posexplode(F.reverse("path")).alias("n", "at"))
    parts = ways.select(F.col("s").alias("s5"), F.col("u").alias("u5"), F.col("path").alias("part"))
    parts = at.join(parts.hint("merge"), F.col("s").eqNullSafe(F.col("s5")) & (F.col("at") == F.col("u5")))
    in_order = F.flatten(F.sort_array(F.collect_list(F.struct("n", "part")))["part"])
    return parts.groupBy(F.col("s").alias("s4"), F.col("u").alias("u4")).agg(F.concat(in_order, F.array(F.first("first"))).alias("_above"))
