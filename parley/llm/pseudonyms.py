r"""Format-preserving Feistel pseudonyms for personal data (DataFrame functions only).

Values are found by pattern, validated, and replaced by a keyed permutation of the values of the same format, so
equal values get equal pseudonyms in all documents and different values different ones. Of cards and phones the digits
alone are the value, and their signs are put back, so all spellings of one are linked (with and without a country code are
two values):

    card      13 to 19 digits (also in groups) of which the first is one of payment cards (3 to 6), with a right Luhn
              check digit; the first digit is moved among 3 to 6, the last is made right again
    phone     +C (NNN) NNN-NNNN, NNN-NNN-NNNN and the like with 10 digits; the first digits of area and exchange are
              moved among 2 to 9, that of a country code among 1 to 9
    ssn       NNN-NN-NNNN without the parts that are never given out (000, 666, 9xx; 00; 0000), moved among all others
    ip        four numbers from 0 to 255, each of which stays in that range
    date      YYYY-MM-DD (also with / or .) of a real day from 1900 to 2099, moved among all these days
    email     letters and digits of the name (the domain and all signs stay)
    secret    letters and digits of a value after password=, token=, api_key= and the like (also quoted), and AKIA keys

A value is a list of places, each with a radix (10 for digits, 26 for letters, 256 for parts of an address, 898, 99 and
9999 for parts of an ssn, 17 and 4297 for the number of a day, whose product is that of the days). Their product is the
number of valid values of the format, so no step leads out of these. Rounds alternate between even and odd places: the
places of one half are moved, modulo their radix, by numbers that the SHA-256 of the key, the round and the other half
gives. This is a Feistel network on mixed radices, thus a bijection; `restored` runs the rounds backwards.

Defined cases: null text stays null and has no values; a value that is not valid stays as it is; repeated rows are
treated each, and equal values (ties) get equal pseudonyms; texts of any length are one row's work; a null doc_id stays
null; an empty table gives no rows; further columns of any name are kept, but for one called pii_kinds, which
`pseudonymised` gives anew.
"""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
#: What finds each kind, in order of precedence.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|token|secret|api_?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}[\"']?",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
_GROUPS = {k: (p.replace(r"\1", r"\k<sep>").replace("([-/.])", "(?<sep>[-/.])")) for k, p in KINDS.items()}
PATTERN = "|".join(f"(?:{p})" for p in _GROUPS.values())

Places = Column  # array<struct<v int, r int>>: a value and its radix at each place; radix 1 stays


def feistel(places: Column, key: str, kind: str, back: bool = False) -> Column:
    """The places after all rounds, as an array of values."""

    def one(p: Column, r: Column) -> Column:
        moved = lambda i: i % 2 == r % 2
        rest = F.array_join(F.transform(p, lambda x, i: F.when(moved(i), F.lit("_")).otherwise(x["v"].cast("string"))), ",")
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), rest)

        def stepped(seed: Column) -> Column:
            # each place takes 12 hex digits of a digest for it and its neighbours
            draw = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", seed, F.floor(i / 5).cast("string")), 256), (i % 5) * 12 + 1, F.lit(12)), 16, 10).cast("long")
            step = lambda x, i: F.pmod(x["v"].cast("long") + draw(i) * (-1 if back else 1), x["r"].cast("long")).cast("int")
            return F.transform(p, lambda x, i: F.struct(F.when(moved(i) & (x["r"] > 1), step(x, i)).otherwise(x["v"]).alias("v"), x["r"].alias("r")))

        return F.get(F.transform(F.array(seed), stepped), 0)

    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    return F.transform(F.aggregate(rounds, places, one), lambda x: x["v"])


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _at(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[A-Z]"), F.ascii(c) - 65).when(c.rlike("[a-z]"), F.ascii(c) - 97).otherwise(0)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)


def _char(c: Column, v: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.char(v + 48)).when(c.rlike("[A-Z]"), F.char(v + 65)).when(c.rlike("[a-z]"), F.char(v + 97)).otherwise(c)


def _moved(value: Column, fixed, key: str, kind: str, back: bool, low=None, top=None) -> Column:
    """value with its letters and digits permuted but for the places for which fixed(value, i) holds, i from 0.
    low(value, i): the least digit of a place, top(value, i) the largest; one that is less than low stays."""
    least = lambda i: low(value, i) if low else F.lit(0)
    most = lambda i: top(value, i) if top else F.lit(9)
    radix = lambda c, i: F.when(c.rlike("[0-9]"), F.when(_at(c) < least(i), 1).otherwise(most(i) + 1 - least(i))).otherwise(_radix(c))
    base = lambda c, i: F.when(c.rlike("[0-9]") & (_at(c) >= least(i)), least(i)).otherwise(0)
    places = F.transform(_chars(value), lambda c, i: F.struct((_at(c) - base(c, i)).cast("int").alias("v"), F.when(fixed(value, i), 1).otherwise(radix(c, i)).cast("int").alias("r")))
    if not low:
        return F.array_join(F.zip_with(_chars(value), feistel(places, key, kind, back), _char), "")
    bases = F.transform(_chars(value), base)
    return F.array_join(F.zip_with(_chars(value), F.zip_with(feistel(places, key, kind, back), bases, lambda a, b: a + b), _char), "")


def _digits_before(value: Column, i: Column) -> Column:
    return F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9]", ""))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counting once."""
    d = F.reverse(_chars(digits))
    return F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))), F.lit(0), lambda a, x: a + x)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _once(value: Column, use) -> Column:
    """use(value), in which value is computed once however often it is read."""
    return F.get(F.transform(F.array(value), use), 0)


def _spelled(value: Column, digits: Column) -> Column:
    """value with its digits replaced one by one."""
    put = lambda d: F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(d, _digits_before(value, i) + 1, F.lit(1))).otherwise(c)), "")
    return _once(digits, put)


def _card(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    body = _moved(F.substring(digits, F.lit(1), F.length(digits) - 1), lambda v, i: F.lit(False), key, "card", back, lambda v, i: F.when(i == 0, 3).otherwise(0), lambda v, i: F.when(i == 0, 6).otherwise(9))
    return _spelled(value, _once(body, lambda d: F.concat(d, ((10 - _luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string"))))


def _phone(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    many = F.length(digits)
    low = lambda v, i: F.when((i == many - 10) | (i == many - 7), 2).when(i == 0, 1).otherwise(0)
    return _spelled(value, _moved(digits, lambda v, i: F.lit(False), key, "phone", back, low))


def _ssn(value: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.get(F.split(value, "-"), i).cast("int") for i in range(3))
    place = lambda v, r: F.struct(v.cast("int").alias("v"), F.lit(r).alias("r"))
    out = feistel(F.array(place(area - F.when(area > 666, 2).otherwise(1), 898), place(group - 1, 99), place(serial - 1, 9999)), key, "ssn", back)
    padded = lambda v, n: F.lpad(v.cast("string"), n, "0")
    area = F.get(out, 0) + F.when(F.get(out, 0) >= 665, 2).otherwise(1)
    return F.concat_ws("-", padded(area, 3), padded(F.get(out, 1) + 1, 2), padded(F.get(out, 2) + 1, 4))


def _email(value: Column, key: str, back: bool) -> Column:
    return _moved(value, lambda v, i: i >= F.instr(v, "@") - 1, key, "email", back)


def _secret(value: Column, key: str, back: bool) -> Column:
    start = F.when(value.startswith("AKIA"), 4).otherwise(F.length(F.regexp_extract(value, r"^[A-Za-z_]+\s*[=:]\s*[\"']?", 0)))
    return _moved(value, lambda v, i: i < start, key, "secret", back)


def _ip(value: Column, key: str, back: bool) -> Column:
    places = F.transform(F.split(value, r"\."), lambda p: F.struct(p.cast("int").alias("v"), F.lit(256).alias("r")))
    return F.array_join(F.transform(feistel(places, key, "ip", back), lambda v: v.cast("string")), ".")


def _date(value: Column, key: str, back: bool) -> Column:
    first, sign = F.to_date(F.lit("1900-01-01")), F.substring(value, 5, 1)
    day = F.date_diff(F.try_to_date(F.replace(value, sign, F.lit("-")), "yyyy-MM-dd"), first)
    place = lambda v, r: F.struct(v.cast("int").alias("v"), F.lit(r).alias("r"))
    out = feistel(F.array(place(day % 17, 17), place(F.floor(day / 17), 4297)), key, "date", back)
    return F.replace(F.date_format(F.date_add(first, F.get(out, 0) + 17 * F.get(out, 1)), "yyyy-MM-dd"), F.lit("-"), sign)


MOVES = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(value: Column) -> Column:
    """The kind of a found value, or null if it is not valid."""
    d = _digits(value)
    parts = F.split(value, r"\.")
    whole = lambda k: value.rlike(f"^(?:{_GROUPS[k]})$")
    day = F.try_to_date(F.regexp_replace(F.when(whole("date"), value), "[/.]", "-"), "yyyy-MM-dd")
    return (
        F.when(whole("email"), "email")
        .when(whole("secret"), "secret")
        .when(whole("ip"), F.when(F.forall(parts, lambda p: (p.cast("int") <= 255) & (p == p.cast("int").cast("string"))), "ip"))
        .when(whole("date"), F.when(day.isNotNull(), "date"))
        .when(whole("ssn"), F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole("phone"), F.when(F.substring(d, -10, 1).between("2", "9") & F.substring(d, -7, 1).between("2", "9"), "phone"))
        .when(whole("card"), F.when(d.rlike("^[3-6]") & (_luhn_sum(d) % 10 == 0), "card"))
    )


def _replaced(documents: DataFrame, key: str, back: bool) -> DataFrame:
    """row (a struct of all columns), text and kinds; only its own columns stand beside the row, so none can clash."""
    moved = lambda x: functools.reduce(lambda c, k: c.when(x["kind"] == k, MOVES[k](x["value"], key, back)), MOVES, F.when(x["kind"].isNull(), x["value"]))
    rows = documents.select(F.struct("*").alias("row")).withColumn("found", F.regexp_extract_all("row.text", F.lit(PATTERN), F.lit(0)))
    values = F.transform("found", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    rows = rows.withColumn("values", F.when(F.size("found") > 0, values))
    rest = F.split("row.text", PATTERN, -1)
    text = F.array_join(F.zip_with(rest, F.transform("values", moved), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.exists("values", lambda x: x["kind"].isNotNull()), text).otherwise(F.col("row.text"))
    kinds = F.coalesce(F.filter(F.transform("values", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return rows.select("row", text.alias("text"), kinds.alias("kinds"))


def pseudonymised(documents: DataFrame, key: str) -> DataFrame:
    """documents with text pseudonymised and pii_kinds, the kinds of the values that were replaced, in order."""
    out = _replaced(documents.drop("pii_kinds"), key, False)
    return out.select(F.col("row").withField("text", F.col("text")).alias("row"), "kinds").select("row.*", F.col("kinds").alias("pii_kinds"))


def restored(documents: DataFrame, key: str) -> DataFrame:
    """documents with the values that `pseudonymised` put there replaced by the first ones."""
    return _replaced(documents, key, True).select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


KEY = "spark.parley.pseudonyms.key"
_drawn: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key that the session's setting KEY names; without it one is drawn for the application, so its pseudonyms are
    linked within it but can't be restored later."""
    return spark.conf.get(KEY, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op9_feistel_pseudonyms(spark, sf_dir):
    out = pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", F.size("pii_kinds").cast("long").alias("n_found"), *[count(kind) for kind in KINDS], "text")
