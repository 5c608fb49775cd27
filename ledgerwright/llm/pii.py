"""Personal data replaced by format-preserving Feistel pseudonyms (native expressions only).

Found values are validated and then permuted, by a keyed permutation, among the values
of their own format, so equal values get equal pseudonyms in all documents:

* card numbers (13 to 19 digits with a valid Luhn digit): all digits but the last are
  permuted, the last is the Luhn digit of the result; separators stay;
* phone numbers: the ten national digits are permuted, the rest of the format stays. They
  are NNN-NNN-NNNN, (NNN) NNN-NNNN, both with or without a country code, and ``+``, an
  assigned country code and its national digits, together or in groups; where fewer than
  ten digits follow the country code, those are permuted;
* IPv4 addresses, but for 0.x.x.x, 127.x.x.x, 255.255.255.255 and four single digits
  (those are version numbers more often): permuted among all 2^32;
* social security style numbers whose area is not 000, 666 or 9xx, group not 00 and serial
  not 0000: the nine digits;
* ISO dates (a real day from 1900-01-01 to 2099-08-05): the 72,900 days are permuted; dates
  written otherwise are not touched;
* hexadecimal keys of 32 to 64 digits, at least 8 of them different: pieces of 24 digits as
  pairs of numbers;
* e-mail addresses: letters and digits are permuted within their class by a Feistel
  network over the two halves of the string; the top-level domain stays.

Numeric values are pairs (a, b) in Z_A x Z_B; a round adds a keyed hash (HMAC-SHA256) of
one half to the other. A pseudonym that would not pass its format's validation
is permuted again until it passes (cycle walking, up to WALKS times), so pseudonyms are
valid and the permutation can be undone with the key. A text is
split at the found values and joined again, so everything between them stays byte for
byte. Values that fail validation stay. Phone numbers are known by their form alone.

The key is the caller's secret: whoever has it can undo the pseudonyms.

Cases: null texts stay null; texts without values stay; repeated rows get equal
results; extra columns are kept, except that those named like ``out_col`` and
``count_col`` are replaced; names that start with ``_pii_`` are the operator's own.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats (fixed patterns), tried in this order at each place.
_CODE = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[0578][0-9]|9[679][0-9])"  # country codes
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    rf"|(?<![0-9])\+(?:(?:[17]|44)(?:[ .-]?[0-9]){{10}}|(?![17]|44){_CODE}(?:[ .-]?[0-9]){{6,12}})(?![0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
ROUNDS = 8
_DAYS = 270  # squared: days of the date format


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


#: The setting that names the secret of a session.
KEY_SETTING = "spark.ledgerwright.pii.key"


def session_key(spark: SparkSession) -> str:
    """The session's secret from KEY_SETTING; without one a random secret, drawn once for the session."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal of a string's UTF-8 bytes."""
    secret = key.encode()
    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _prf(key: str, kind: str, turn: Column, half: Column) -> Column:
    """A keyed hash of 48 bits."""
    digest = hmac_sha256(key, F.concat_ws("|", F.lit(kind), turn.cast("string"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """The keyed permutation of (a, b) in Z_A x Z_B, as a struct of ``a`` and ``b``."""

    def turn(acc, i):
        f = _prf(key, kind, i, F.when(i % 2 == 0, acc["b"]).otherwise(acc["a"]))
        f = -f if inverse else f
        return F.struct(F.when(i % 2 == 0, F.pmod(acc["a"] + f, size_a)).otherwise(acc["a"]).alias("a"), F.when(i % 2 == 0, acc["b"]).otherwise(F.pmod(acc["b"] + f, size_b)).alias("b"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def permuted_digits(d: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A string of 2 to 30 digits permuted among those of its length."""
    half = F.floor(F.length(d) / 2).cast("int")

    def done(h):
        size_a, size_b = (F.rpad(F.lit("1"), n + 1, "0").cast("long") for n in (h, F.length(d) - h))
        x = feistel(F.substr(d, F.lit(1), h).cast("long"), F.substr(d, h + 1).cast("long"), size_a, size_b, key, kind, inverse)
        return let(x, lambda p: F.concat(F.lpad(p["a"].cast("string"), h, "0"), F.lpad(p["b"].cast("string"), F.length(d) - h, "0")))

    return let(half, done)


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(shape, ""),
        start,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: acc["s"],
    )


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """The Luhn sum; ``first_doubled`` 0: the last digit is doubled, 1: the one before it."""
    return F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == first_doubled, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _card(m: Column, key: str, inverse: bool) -> Column:
    def done(d):
        body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse)
        full = let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d, 1), F.lit(10)) == 0, refilled(m, full)).otherwise(m)

    return let(_digits(m), done)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """The last ten digits, or all after the country code where fewer follow it."""

    def done(d):
        grouped = m.rlike(r"\(|^\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")
        code = F.when(m.startswith("+") & ~grouped, F.length(F.regexp_extract(d, f"^{_CODE}", 0))).otherwise(0)
        n = F.least(F.lit(10), F.length(d) - code)
        return refilled(m, F.concat(F.substr(d, F.lit(1), F.length(d) - n), permuted_digits(F.right(d, n), key, "phone", inverse)))

    return let(_digits(m), done)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    part = lambda k: F.split(m, r"\.")[k].cast("long")
    x = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ip", inverse)
    return let(x, lambda p: F.concat_ws(".", *(v.cast("string") for h in (p["a"], p["b"]) for v in (F.floor(h / 256), h % 256))))


def _date(m: Column, key: str, inverse: bool) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def done(day):
        n = F.datediff(day, first)
        x = feistel(F.floor(n / _DAYS), n % _DAYS, F.lit(_DAYS), F.lit(_DAYS), key, "date", inverse)
        moved = let(x, lambda p: F.date_format(F.date_add(first, (p["a"] * _DAYS + p["b"]).cast("int")), "yyyy-MM-dd"))
        return F.when(n < _DAYS * _DAYS, moved).otherwise(m)

    return let(F.try_to_date(m, "yyyy-MM-dd"), lambda day: F.when(day.isNull(), m).otherwise(done(day)))


def _shifted(chars: Column, stream: Column, sign: int) -> Column:
    """Letters and digits moved within their class by the bytes of a hex ``stream``."""

    def one(c, i):
        by = sign * F.conv(F.substr(stream, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code, moved = F.ascii(c), None
        for low, n in ((48, 10), (97, 26), (65, 26)):
            hit = (code >= low) & (code < low + n) & (F.octet_length(c) == 1)
            to = F.char(F.pmod(code - low + by, F.lit(n)) + low)
            moved = F.when(hit, to) if moved is None else moved.when(hit, to)
        return moved.otherwise(c)

    return F.transform(chars, one)


def permuted_letters(s: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A string permuted among the strings with the same class of character in each place."""

    def turn(acc, i):
        other = F.when(i % 2 == 0, acc["b"]).otherwise(acc["a"])
        stream = hmac_sha256(key, F.concat_ws("|", F.lit(kind), i.cast("string"), F.size(acc["a"]).cast("string"), F.array_join(other, "")))
        half = F.when(i % 2 == 0, acc["a"]).otherwise(acc["b"])
        moved = let(stream, lambda t: _shifted(half, t, -1 if inverse else 1))
        return F.struct(F.when(i % 2 == 0, moved).otherwise(acc["a"]).alias("a"), F.when(i % 2 == 0, acc["b"]).otherwise(moved).alias("b"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def done(chars):
        half = F.floor(F.size(chars) / 2).cast("int")
        return F.aggregate(turns, F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b")), turn, lambda p: F.array_join(F.concat(p["a"], p["b"]), ""))

    return let(F.split(s, ""), done)


def _email(m: Column, key: str, inverse: bool) -> Column:
    end = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(permuted_letters(F.substr(m, F.lit(1), F.length(m) - F.length(end)), key, "email", inverse), end)


def _hex(m: Column, key: str, inverse: bool) -> Column:
    """Pieces of 24 digits, each a pair of 48-bit numbers or shorter."""
    upper = m.rlike("[A-F]")

    def piece(p):
        half = F.floor(F.length(p) / 2).cast("int")
        to_long = lambda x: F.conv(x, 16, 10).cast("long")
        size = lambda n: F.pow(F.lit(16), n).cast("long")
        rest = F.length(p) - half
        x = feistel(to_long(F.substr(p, F.lit(1), half)), to_long(F.substr(p, half + 1)), size(half), size(rest), key, "key", inverse)
        return let(x, lambda y: F.lower(F.concat(F.lpad(F.hex(y["a"]), half, "0"), F.lpad(F.hex(y["b"]), rest, "0"))))

    pieces = F.transform(F.sequence(F.lit(1), F.length(m), F.lit(24)), lambda at: F.substr(m, at, F.lit(24)))
    out = F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) < 2, p).otherwise(piece(p))), "")
    return F.when(upper, F.upper(out)).otherwise(out)


#: Further permutations at most where one gives a value that is not valid; a chance of about 1 in 10 each, for numbers.
WALKS = 12


def valid(kind: str, m: Column) -> Column:
    """Whether a value of the right form is one that the format allows."""
    if kind == "ip":
        return ~m.rlike(r"^(?:0|127)\.|^255\.255\.255\.255$|^[0-9](?:\.[0-9]){3}$")
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "key":
        return F.size(F.array_distinct(F.split(F.lower(m), ""))) >= 8
    return F.lit(True)


def _walked(m: Column, kind: str, once) -> Column:
    """``once`` applied until its value is valid; values that are not valid themselves stay."""

    def step(x, _):
        return F.when(valid(kind, x), x).otherwise(once(x))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(m), step)
    return F.when(valid(kind, m), walk).otherwise(m)


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value, by its format."""
    at_start = {k: m.rlike(f"^(?:{p})$") for k, p in FORMATS.items()}
    digits = lambda x: let(_digits(x), lambda d: refilled(x, permuted_digits(d, key, "ssn", inverse)))
    return (
        F.when(at_start["email"], _email(m, key, inverse))
        .when(at_start["key"], F.when(valid("key", m), _hex(m, key, inverse)).otherwise(m))
        .when(at_start["ip"], _walked(m, "ip", lambda x: _ip(x, key, inverse)))
        .when(at_start["phone"], _phone(m, key, inverse))
        .when(at_start["date"], _date(m, key, inverse))
        .when(at_start["ssn"], _walked(m, "ssn", digits))
        .when(at_start["card"], _card(m, key, inverse))
        .otherwise(m)
    )


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", out_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """``df`` with the values in ``text_col`` replaced; ``count_col`` gets the number of values that changed.

    Only texts in which a value is found are split; ``pseudonymize`` with other keys gives unrelated pseudonyms.
    """
    out_col = out_col or text_col
    own = df.select(*(c for c in df.columns if c not in (count_col, "_pii_text", "_pii_found", "_pii_new")), F.col(text_col).alias("_pii_text"))
    text = F.col("_pii_text")
    split = own.withColumn("_pii_found", F.when(text.rlike("[0-9@]|[A-Fa-f]{32}"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    has = F.size("_pii_found") > 0
    split = split.withColumn("_pii_new", F.when(has, F.transform("_pii_found", lambda m: pseudonym(m, key))))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat("_pii_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    new = {out_col: F.when(has, joined).otherwise(text)}
    if count_col:
        changed = F.size(F.filter(F.zip_with("_pii_found", "_pii_new", lambda a, b: a != b), lambda x: x))
        new[count_col] = F.when(has, changed).otherwise(0).cast("long")
    return split.withColumns(new).drop("_pii_text", "_pii_found", "_pii_new")
