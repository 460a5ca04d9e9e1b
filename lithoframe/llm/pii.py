"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Candidates are found by one regular expression, validated by kind (check digits, ranges,
calendar), and each valid value is permuted within its own format: digits are split into
two halves that take turns in adding a keyed hash of the other, modulo a power of ten, so
that different values stay different and equal values get equal pseudonyms in every
document, without any table. Separators and layout stay as they are.

- payment cards (13 to 19 digits, Luhn): all digits but the check digit, which is then
  computed anew;
- telephone numbers: the last ten digits at most; behind a plus sign the country code stays;
- social security numbers: nine digits, walked on until valid again;
- IPv4 addresses: 32 bits;
- dates (year-month-day, or day and month before the year): the days of the years 1900 to 2099;
- e-mail addresses and long hexadecimal secrets: a keyed token of their own length class.

Everything is built from SQL expressions over the row; no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key of the permutation; a deployment passes its own.
KEY = "change-me"
ROUNDS = 8
_FIRST_DAY, _DAYS = "1900-01-01", 73049

# a domain name has 127 labels at most; an unbounded group would take a stack frame for each
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,126}"
_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?<sep>[./-])[0-9]{1,2}\k<sep>[0-9]{4})(?![0-9]|[./-][0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}|[0-9]{4}(?<gop>[ -])[0-9]{6}\k<gop>[0-9]{5})(?![0-9])"
_PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{8,15}(?![0-9])"
_ANY = "|".join([_EMAIL, _SECRET, _IP, _DATE, _SSN, _CARD, _PHONE])


#: Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)).cast("binary"), 256)


def _number(hexed: Column) -> Column:
    """A whole number of 60 bits from the front of a hexadecimal digest."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of pairs (a below size_a, b below size_b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["a"] + _number(_digest(key, kind, i, size_a, size_b, s["b"])) % size_a, size_a)
        right = F.pmod(s["b"] + _number(_digest(key, kind, i, size_a, size_b, s["a"])) % size_b, size_b)
        return F.when(i % 2 == 0, F.struct(left.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), right.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, key: str, kind: Column) -> Column:
    """The keyed permutation of a string of 2 to 36 digits, as a string of as many."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = _feistel(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long"), ten(half), ten(n - half), key, kind)
    whole = F.transform(F.array(pair), lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), n - half, "0")))
    return whole[0]


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that stand before a check digit."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), state, step, lambda s: s["out"])


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _card(value: Column, key: str) -> Column:
    def on(digits: Column) -> Column:
        body, check = F.substr(digits, F.lit(1), F.length(digits) - 1), F.substr(digits, F.length(digits))
        valid = (check == _check_digit(body)) & (F.regexp_replace(digits, "0", "") != "")
        new = _bound(permuted_digits(body, key, F.lit("card")), lambda b: F.concat(b, _check_digit(b)))
        return F.when(valid, _laid_out(value, new))

    return _bound(F.regexp_replace(value, "[^0-9]", ""), on)


def _phone(value: Column, key: str) -> Column:
    def on(digits: Column) -> Column:
        n = F.length(digits)
        code = F.when(~F.startswith(value, F.lit("+")), 0).when(digits.rlike("^[17]"), 1).when(F.substr(digits, F.lit(1), F.lit(2)).isin(_TWO_DIGITS), 2).otherwise(3)
        kept = F.greatest(n - 10, code)
        new = F.concat(F.substr(digits, F.lit(1), kept), permuted_digits(F.substr(digits, kept + 1), key, F.lit("phone")))
        return F.when(n.between(8, 15), _laid_out(value, new))

    return _bound(F.regexp_replace(value, "[^0-9]", ""), on)


def _ssn_valid(d: Column) -> Column:
    area = F.substr(d, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000")


def _ssn(value: Column, key: str) -> Column:
    def on(digits: Column) -> Column:
        # cycle walking: permute again until valid; about one in nine is not, so 40 steps fail less than once in 1e37
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(40)),
            F.struct(digits.alias("d"), F.lit(False).alias("done")),
            lambda s, i: F.when(s["done"], s).otherwise(_bound(permuted_digits(s["d"], key, F.lit("ssn")), lambda d: F.struct(d.alias("d"), _ssn_valid(d).alias("done")))),
            lambda s: s["d"],
        )
        return F.when(_ssn_valid(digits), _laid_out(value, walked))

    return _bound(F.regexp_replace(value, "[^0-9]", ""), on)


def _ip(value: Column, key: str) -> Column:
    def on(p: Column) -> Column:
        pair = _feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"))
        text = _bound(pair, lambda s: F.concat_ws(".", (s["a"] / 256).cast("int").cast("string"), (s["a"] % 256).cast("string"), (s["b"] / 256).cast("int").cast("string"), (s["b"] % 256).cast("string")))
        return F.when(~F.exists(p, lambda x: x > 255), text)

    return _bound(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), on)


def _date(value: Column, key: str) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    sep = F.regexp_extract(value, "[./-]", 0)

    def on(p: Column) -> Column:
        y, m, d = (F.when(iso, p[i]).otherwise(p[j]) for i, j in ((0, 2), (1, 1), (2, 0)))
        # month before day where only that is a date
        swap = ~iso & (p[1] > 12) & (p[0] <= 12)
        day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, F.when(swap, p[0]).otherwise(m), F.when(swap, p[1]).otherwise(d)), F.lit("yyyy-MM-dd")).cast("date")
        at = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
        # 271 * 270 pairs cover the days; walk on past the few that lie beyond
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(30)),
            F.struct(at.cast("long").alias("n"), F.lit(False).alias("done")),
            lambda s, i: F.when(s["done"], s).otherwise(
                _bound(
                    _feistel((s["n"] / 270).cast("long"), s["n"] % 270, F.lit(271).cast("long"), F.lit(270).cast("long"), key, F.lit("date")),
                    lambda q: F.struct((q["a"] * 270 + q["b"]).alias("n"), (q["a"] * 270 + q["b"] < _DAYS).alias("done")),
                )
            ),
            lambda s: s["n"],
        )
        def shown(new: Column) -> Column:
            yy, mm, dd = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
            return F.when(iso, F.concat_ws("-", yy, mm, dd)).when(swap, F.concat(mm, sep, dd, sep, yy)).otherwise(F.concat(dd, sep, mm, sep, yy))

        return F.when(at.between(0, _DAYS - 1), _bound(F.date_add(F.lit(_FIRST_DAY).cast("date"), walked.cast("int")), shown))

    return _bound(F.transform(F.split(value, "[./-]"), lambda x: x.cast("int")), on)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.substring(_digest(key, F.lit("email"), F.lower(value)), 1, 24), F.lit("@example.invalid"))


def _secret(value: Column, key: str) -> Column:
    token = F.concat(*(_digest(key, F.lit("secret"), F.lit(i), F.lower(value)) for i in range(2)))
    token = F.substr(token, F.lit(1), F.length(value))
    return F.when(value == F.upper(value), F.upper(token)).otherwise(token)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one matched value, or null if it is valid as no kind."""
    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key))
        .when(value.rlike("^[0-9A-Fa-f]{32,}$"), _secret(value, key))
        .when(value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), _ip(value, key))
        .when(value.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4})$"), _date(value, key))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(value, key))
        .when(value.rlike("^[0-9]") & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 13), _card(value, key))
        .otherwise(_phone(value, key))
    )


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with personal data in its text replaced, and n_replaced.

    A null text stays null with 0 replaced; rows that repeat come out alike, and an empty
    table gives an empty one. Equal values (letter case aside for
    addresses and secrets) get equal pseudonyms wherever they occur; what fails
    validation stays. Other columns stay; columns named like the results are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "n_replaced")]
    # most texts have no candidate at all: a cheap test spares them the rest
    found = F.when(F.col(text).rlike("[0-9@]") | F.col(text).rlike("[A-Fa-f]{32}"), F.regexp_extract_all(F.col(text), F.lit(_ANY), F.lit(0)))
    step = docs.withColumn("__found", found)
    new = F.transform("__found", lambda m: pseudonym(m, key))
    step = step.withColumn("__new", F.when(F.size("__found") > 0, new))
    gaps = F.split(F.col(text), _ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.col("__found").alias("f"), F.col("__new").alias("n")), lambda z: F.concat(z["g"], F.coalesce(z["n"], z["f"], F.lit("")))), "")
    return step.select(*rest, F.when(F.col("__new").isNull(), F.col(text)).otherwise(joined).alias(text), F.when(F.col("__new").isNull(), 0).otherwise(F.size(F.filter("__new", lambda x: x.isNotNull()))).cast("long").alias("n_replaced"))
