"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Validated numbers and dates are permuted within their format by a keyed Feistel network: a value is two residues (left mod a,
right mod b), and each round adds a keyed hash of one to the other, which is a bijection of the format's values. So a card
number becomes another valid card number, a date another date, and equal values become equal pseudonyms in every document. The
parts of an e-mail address, which have no numeric format, become keyed tokens.

No pattern repeats a group without bound unless possessively, which the JVM's matcher does in a loop; a greedy one would recurse
once a repetition and overflow the stack on a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, quoted, text_or_empty

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_MONTH, _DAY, _YEAR = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9]{2}"
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9])(?:{_YEAR}([-/]){_MONTH}\1{_DAY}|{_MONTH}/{_DAY}/{_YEAR}|{_DAY}\.{_MONTH}\.{_YEAR})(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2,5}){2,4}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9][0-9]{7,14}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
KINDS = tuple(PATTERNS)
#: All kinds but addresses with an @ begin with a digit, a bracket or a plus sign: other places are passed over at once. The date's separator is group 1 of the whole pattern.
NUMBERS = "(?=[0-9(+])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "email") + ")"
ANY = f"{PATTERNS['email']}|{NUMBERS}"
#: Stands around each match while a text is taken apart; texts that hold it themselves are taken apart in two passes.
MARK = "\ufdd0"
ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31; 73049 = 319 * 229


def permuted(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: str) -> Column:
    """struct(l, r): the keyed permutation of the pairs of residues (left mod a, right mod b)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def f(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(tweak), i.cast("string"), a.cast("string"), b.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + F.pmod(f(i, s["r"]), a), a).cast("long").alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(f(i, s["l"]), b), b).cast("long").alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _part(s: Column, start: Column | int, length: Column | int) -> Column:
    return F.substr(s, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), F.lit(width) if isinstance(width, int) else width, F.lit("0"))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, of which the last is the check digit's place."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _part(digits, n - i, 1).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order, by others."""

    def char(i: Column) -> Column:
        c = _part(m, i, 1)
        return F.when((c >= "0") & (c <= "9"), _part(digits, F.length(_digits(_part(m, 1, i))), 1)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _number(d: Column, key: Column, tweak: str) -> Column:
    """Another string of as many digits."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    out = permuted(_part(d, 1, half).cast("long"), _part(d, half + 1, n - half).cast("long"), _ten(half), _ten(n - half), key, tweak)
    return _let(out, lambda s: F.concat(_pad(s["l"], half), _pad(s["r"], n - half)))


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    body = _number(_part(d, 1, F.length(d) - 1), key, "card")
    full = _let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return _refilled(m, full)


def _national(d: Column, key: Column) -> Column:
    """Another ten-digit number: area and exchange codes that may not begin with 0 or 1 get others that don't, and those that do get others that do."""
    area, exchange, line = (_part(d, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    low, size = lambda x: F.when(x >= 200, 200).otherwise(0), lambda x: F.when(x >= 200, 800).otherwise(200)
    out = permuted(area - low(area), (exchange - low(exchange)) * 10_000 + line, size(area), size(exchange) * 10_000, key, "phone")
    return _let(out, lambda s: F.concat(_pad(s["l"] + low(area), 3), _pad(F.floor(s["r"] / 10_000) + low(exchange), 3), _pad(s["r"] % 10_000, 4)))


def _phone(m: Column, key: Column) -> Column:
    """The country's code stays: the digits before a ten-digit number, or in other international numbers the first digit (1 and 7) or two."""
    d = _digits(m)
    n = F.length(d)
    ten = ~m.startswith("+") | m.rlike(r"^\+[0-9]{1,3}[ .-]?(\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}$") | ((n == 11) & d.startswith("1"))
    code = F.when(ten, n - 10).when(d.rlike("^[17]"), 1).otherwise(2)
    rest = _part(d, code + 1, n - code)
    return _let(F.concat(_part(d, 1, code), F.when(ten, _national(rest, key)).otherwise(_number(rest, key, "phone"))), lambda x: _refilled(m, x))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    at = lambda i: F.element_at(o, i)
    out = permuted(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536), key, "ip")
    return _let(out, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _ssn(m: Column, key: Column) -> Column:
    d = _digits(m)
    area, rest = _part(d, 1, 3).cast("long"), (_part(d, 4, 2).cast("long") - 1) * 9999 + _part(d, 6, 4).cast("long") - 1
    out = permuted(area - F.when(area > 666, 2).otherwise(1), rest, F.lit(898), F.lit(99 * 9999), key, "ssn")
    return _let(out, lambda s: F.concat_ws("-", _pad(s["l"] + F.when(s["l"] + 1 >= 666, 2).otherwise(1), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4)))


def _date_parts(m: Column) -> Column:
    """The day of m; null if there is no such day."""
    first = m.rlike("^[0-9]{4}")
    text = F.when(first, F.translate(m, "/", "-")).when(m.contains("."), F.concat_ws("-", _part(m, 7, 4), _part(m, 4, 2), _part(m, 1, 2))).otherwise(F.concat_ws("-", _part(m, 7, 4), _part(m, 1, 2), _part(m, 4, 2)))
    return F.try_to_date(text, "yyyy-MM-dd")


def _date(m: Column, key: Column) -> Column:
    n = F.date_diff(_date_parts(m), F.lit(FIRST_DAY).cast("date")).cast("long")
    out = permuted(F.floor(n / 229), n % 229, F.lit(319), F.lit(229), key, "date")
    day = _let(out, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * 229 + s["r"]).cast("int")))
    shape = F.when(m.rlike("^[0-9]{4}-"), F.lit("yyyy-MM-dd")).when(m.rlike("^[0-9]{4}/"), F.lit("yyyy/MM/dd")).when(m.contains("."), F.lit("dd.MM.yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    return _let(day, lambda x: F.when(shape == "yyyy-MM-dd", F.date_format(x, "yyyy-MM-dd")).when(shape == "yyyy/MM/dd", F.date_format(x, "yyyy/MM/dd")).when(shape == "dd.MM.yyyy", F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "MM/dd/yyyy")))


def _email(m: Column, key: Column) -> Column:
    token = lambda x: F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(x)), 256), 1, 16)
    return F.concat(F.lit("u"), token(F.split_part(m, F.lit("@"), F.lit(1))), F.lit("@d"), token(F.split_part(m, F.lit("@"), F.lit(2))), F.lit(".example"))


def kind_of(m: Column) -> Column:
    """Kind of a match of ANY; null if it isn't valid."""
    # whole matches are told apart by their form; the surroundings have been looked at
    form = F.when(m.contains("@"), "email").when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(m.rlike(r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), "date")
    form = form.when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike(r"^([0-9]{13,19}|[0-9]{4}[ -].*)$") & ~m.rlike(r"^[0-9]{3}[.-]"), "card").otherwise("phone")
    return F.when((form == "card") & (luhn_sum(_digits(m)) % 10 != 0), None).when((form == "date") & _date_parts(m).isNull(), None).otherwise(form)


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    out = F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "card", _card(m, key))
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str | DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: the columns keep, n_<kind> for each kind, and text with pseudonyms in place of what was found.

    key: the secret of the permutations, or a table whose one row and column hold it; equal values get equal pseudonyms under
    one key. It reaches the tasks as a broadcast row, so no plan, page or event log shows it. Numbers that fail validation (Luhn
    check of cards, days that don't exist, ranges of addresses and numbers) are left alone. Phones are found as
    area-exchange-line with brackets, points or dashes, and after a plus sign in groups or without any; ten bare digits are not.
    Where kinds could match at one place, the first of KINDS does (ties).

    A null or empty text has nothing in it and gives an empty text; a text of any length is read whole; kept nulls stay; columns
    other than those named are ignored, and a result whose name a kept column has takes leading underscores; repeated rows each
    keep their row; an empty table gives an empty result. The work is row by row: nothing is shuffled.
    """
    spark = docs.sparkSession
    keys = spark.createDataFrame([(key,)], "k string") if isinstance(key, str) else key.toDF("k").limit(1)
    names = [f"keep{k}" for k in range(len(keep))]
    rows = docs.select(*[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)], text_or_empty(text_col).alias("t")).crossJoin(F.broadcast(keys.select(F.col("k").cast("string"))))
    # one pass of the patterns that the text can hold at all: gaps and matches in turn, beginning and ending with a gap
    marks = F.lit(f"{MARK}$0{MARK}")
    marked = F.when(F.contains("t", F.lit("@")), F.regexp_replace("t", F.lit(ANY), marks)).when(F.rlike("t", F.lit("[0-9]")), F.regexp_replace("t", F.lit(NUMBERS), marks)).otherwise(F.col("t"))
    marked = F.split(marked, MARK, -1)
    twice = F.flatten(F.zip_with(F.split("t", ANY, -1), F.concat(F.regexp_extract_all("t", F.lit(ANY), 0), F.array(F.lit(None).cast("string"))), lambda g, m: F.array(g, m)))
    rows = rows.withColumn("parts", F.when(F.contains("t", F.lit(MARK)), F.slice(twice, 1, F.size(twice) - 1)).otherwise(marked))
    # what isn't valid stays, as a gap
    rows = rows.withColumn("found", F.when(F.size("parts") > 1, F.transform("parts", lambda p, i: F.struct(p.alias("m"), F.when(i % 2 == 1, kind_of(p)).alias("kind")))))
    text = F.when(F.col("found").isNull(), F.col("t")).otherwise(F.array_join(F.transform("found", lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(pseudonym(x["m"], x["kind"], F.col("k")))), ""))
    counts = [F.coalesce(F.size(F.filter("found", _is(k))), F.lit(0)) for k in KINDS]
    counts = [F.when(F.col("found").isNull(), F.lit(0)).otherwise(c).cast("long") for c in counts]
    results = free_names(keep, *[f"n_{k}" for k in KINDS], "text")
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[c.alias(n) for c, n in zip([*counts, text], results, strict=True)])


def _is(kind: str):
    return lambda x: x["kind"] == kind
