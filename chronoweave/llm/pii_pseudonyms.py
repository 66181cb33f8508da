"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions alone.

Values are found by one expression, validated by their own rules (check digits, calendar, ranges) and permuted by a
keyed Feistel network within their format, so a value has the same pseudonym in every document, a card number stays a
valid card number of its length, and with the key every change can be undone. Invalid look-alikes stay as they are.

What stays: an IBAN's country and the letters of its bank part, an e-mail's domain and punctuation, a phone number's
first digit (and that of the exchange in the three-three-four form), and forms that aren't listed in KINDS, such as
national phone numbers without country prefix and slashed dates in day-month order. The key is a literal of the plan,
so ``explain`` and the web interface show it: whoever may see these must be allowed to know the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: For tests and examples; a real run passes its own secret.
EXAMPLE_KEY = "example-key"
#: The Gregorian calendar repeats after 146097 = 189 x 773 days: just the days of these four centuries.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773

#: Kinds in order of preference where two start at the same place. Java expressions.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    ("iso_date", r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])"),
    ("day_date", r"(?<![0-9A-Za-z.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"),
    ("month_date", r"(?<![0-9A-Za-z/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z]|/[0-9])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"),
    ("card", r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])|(?<![0-9A-Za-z(+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)


def _keyed(key: str, kind: str) -> str:
    """A key of the kind's own, so that equal digits of two kinds aren't seen to be equal."""
    return hashlib.sha256(f"{kind}:{key}".encode()).hexdigest()


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda it is a variable."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, high: Column, low: Column, high_mod: Column, low_mod: Column, undo: bool = False) -> Column:
    """struct<high, low>: the pair permuted within ``high_mod`` x ``low_mod``; ``undo`` gives the pair back.

    An unbalanced Feistel network: each round adds a keyed hash of one half to the other, modulo that half's size.
    """
    sign = -1 if undo else 1
    state = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))
    rounds = list(range(ROUNDS))

    def permuted(mods):
        def one(acc, odd, mine, other, mod, r):
            moved = F.pmod(mine + sign * F.pmod(_hash(key, r, mod, other), mod), mod)
            return F.struct(F.when(odd, acc["high"]).otherwise(moved).alias("high"), F.when(odd, moved).otherwise(acc["low"]).alias("low"))

        def step(acc, r):
            return F.when(r % 2 == 1, one(acc, F.lit(True), acc["low"], acc["high"], mods["low"], r)).otherwise(one(acc, F.lit(False), acc["high"], acc["low"], mods["high"], r))

        return F.aggregate(F.array(*map(F.lit, rounds[::-1] if undo else rounds)), state, step)

    return _let(F.struct(high_mod.cast("long").alias("high"), low_mod.cast("long").alias("low")), permuted)


def _power(base: int, digits: Column) -> Column:
    return F.element_at(F.array(*(F.lit(base**i) for i in range(19 if base == 10 else 13))), digits + 1).cast("long")


def permute_digits(key: str, digits: Column, undo: bool = False) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""

    def run(x):
        s, n, u = x["s"], F.length(x["s"]), x["u"]
        parts = feistel(key, F.substring(s, F.lit(1), u), F.substring(s, u + 1, n - u), _power(10, u), _power(10, n - u), undo)
        return _let(parts, lambda p: F.concat(F.lpad(p["high"].cast("string"), u, F.lit("0")), F.lpad(p["low"].cast("string"), n - u, F.lit("0"))))

    return _let(F.struct(digits.alias("s"), F.floor(F.length(digits) / 2).cast("int").alias("u")), run)


def permute_letters(key: str, text: Column, undo: bool = False) -> Column:
    """A string of 2 or more of 0-9a-z, permuted among those of its length in runs of 24 (a last single sign joins by rotation)."""

    def run(x):
        s, n, u = x["s"], F.length(x["s"]), x["u"]
        a, b = (F.conv(part, 36, 10) for part in (F.substring(s, F.lit(1), u), F.substring(s, u + 1, n - u)))
        parts = feistel(key, a, b, _power(36, u), _power(36, n - u), undo)
        both = _let(parts, lambda p: F.concat(F.lpad(F.lower(F.conv(p["high"].cast("string"), 10, 36)), u, F.lit("0")), F.lpad(F.lower(F.conv(p["low"].cast("string"), 10, 36)), n - u, F.lit("0"))))
        alone = F.pmod(F.conv(s, 36, 10).cast("long") + (-1 if undo else 1) * F.pmod(_hash(key, F.lit(99)), F.lit(36)), F.lit(36))
        return F.when(n > 1, both).otherwise(F.lower(F.conv(alone.cast("string"), 10, 36)))

    def runs(t):
        part = F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / 24)), lambda i: F.substring(t, (i * 24 + 1).cast("int"), F.lit(24)))
        return F.array_join(F.transform(F.transform(part, lambda s: F.struct(s.alias("s"), F.floor(F.length(s) / 2).cast("int").alias("u"))), run), "")

    return _let(text, runs)


def _into(shape: Column, signs: Column, what: str) -> Column:
    """``shape`` with the characters of class ``what`` replaced, in order, by those of ``signs``; capitals stay capitals."""

    def fill(x):
        def one(i):
            c = F.substring(x["shape"], i, F.lit(1))
            new = F.substring(x["signs"], F.length(F.regexp_replace(F.substring(x["shape"], F.lit(1), i), f"[^{what}]", "")), F.lit(1))
            return F.when(c.rlike("[A-Z]") & c.rlike(f"[{what}]"), F.upper(new)).when(c.rlike(f"[{what}]"), new).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["shape"])), one), "")

    return _let(F.struct(shape.alias("shape"), signs.alias("signs")), fill)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of ``digits``; from the right, those at odd places (from ``shift``) are doubled."""

    def total(back):
        def add(a, i):
            d = F.substring(back, i, F.lit(1)).cast("int") * (1 + (i + shift) % 2)
            return a + d - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)

    return _let(F.reverse(digits), total)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _iban_rest(bank: Column, country: Column, check: Column) -> Column:
    """The IBAN's number modulo 97."""

    def rest_of(text):
        def add(rest, i):
            c = F.substring(text, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)

    return _let(F.concat(bank, country, check), rest_of)


def _card(key: str, m: Column, undo: bool) -> Column:
    def change(digits):
        payload = permute_digits(key, F.substring(digits, F.lit(1), F.length(digits) - 1), undo)
        return _let(payload, lambda p: _into(m, F.concat(p, ((10 - _luhn_sum(p, 0) % 10) % 10).cast("string")), "0-9"))

    return _let(_digits(m), lambda digits: F.when(luhn_valid(digits), change(digits)).otherwise(m))


def _iban(key: str, m: Column, undo: bool) -> Column:
    def change(x):
        new = _into(x["bank"], permute_digits(key, _digits(x["bank"]), undo), "0-9")
        whole = _let(new, lambda b: F.concat(x["country"], F.lpad((98 - _iban_rest(b, x["country"], F.lit("00"))).cast("string"), 2, "0"), b))
        good = (_iban_rest(x["bank"], x["country"], x["check"]) == 1) & (F.length(_digits(x["bank"])) >= 2) & x["check"].between("02", "98")
        return F.when(good, _into(m, whole, "A-Z0-9")).otherwise(m)

    plain = F.replace(m, F.lit(" "), F.lit(""))
    return _let(F.struct(F.substring(plain, 1, 2).alias("country"), F.substring(plain, 3, 2).alias("check"), F.substring(plain, F.lit(5), F.length(plain)).alias("bank")), change)


def _ip(key: str, m: Column, undo: bool) -> Column:
    def change(octets):
        new = feistel(key, octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), undo)
        text = _let(new, lambda p: F.concat_ws(".", *(x.cast("string") for half in (p["high"], p["low"]) for x in (F.floor(half / 256), half % 256))))
        return F.when(F.forall(octets, lambda x: x < 256) & ~m.rlike(r"(^|\.)0[0-9]"), text).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), change)


def _ssn(key: str, m: Column, undo: bool) -> Column:
    def change(part):
        area, group, serial = part[0], part[1], part[2]
        good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        new = feistel(key, area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), undo)

        def text(p):
            high = p["high"] + 1 + F.when(p["high"] + 1 >= 666, 1).otherwise(0)
            return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((high, 3), (F.floor(p["low"] / 9999) + 1, 2), (p["low"] % 9999 + 1, 4))))

        return F.when(good, _let(new, text)).otherwise(m)

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), change)


def _date(key: str, m: Column, undo: bool, order: str, sign: str) -> Column:
    """``order`` names the fields as they stand; each day of 1800 to 2199 goes to another of these."""
    first = F.lit(FIRST_DAY).cast("date")

    def change(part):
        day = F.try_to_date(F.concat_ws("-", *(F.lpad(part[order.index(f)], n, "0") for f, n in (("y", 4), ("m", 2), ("d", 2)))), "yyyy-MM-dd")
        short = (F.length(part[0]) == 1) | (F.length(part[1]) == 1)

        def moved(number):
            new = feistel(key, F.floor(number / DAYS_LOW), number % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW), undo)
            return _let(_let(new, lambda p: F.date_add(first, (p["high"] * DAYS_LOW + p["low"]).cast("int"))), shown)

        def shown(to):
            field = {"y": F.date_format(to, "yyyy"), "m": F.when(short, F.month(to).cast("string")).otherwise(F.date_format(to, "MM")), "d": F.when(short, F.day(to).cast("string")).otherwise(F.date_format(to, "dd"))}
            return F.concat_ws(sign, *(field[f] for f in order))

        return _let(F.datediff(day, first), lambda n: F.when(n.between(0, DAYS_HIGH * DAYS_LOW - 1), moved(n)).otherwise(m))

    return _let(F.split(m, f"[{sign}]"), change)


def _email(key: str, m: Column, undo: bool) -> Column:
    def change(name):
        signs = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
        return F.when(F.length(signs) > 0, F.concat(_into(name, permute_letters(key, signs, undo), "A-Za-z0-9"), F.lit("@"), F.substring_index(m, "@", -1))).otherwise(m)

    return _let(F.substring_index(m, "@", 1), change)


def _phone(key: str, m: Column, undo: bool) -> Column:
    """The first digit stays, and so does that of the exchange in the three-three-four form, which may not be 0 or 1."""

    def change(digits):
        first = F.substring(digits, 1, 1)
        world = F.concat(first, permute_digits(key, F.substring(digits, F.lit(2), F.length(digits)), undo))
        inner = permute_digits(key, F.concat(F.substring(digits, 2, 2), F.substring(digits, 5, 6)), undo)
        home = _let(inner, lambda p: F.concat(first, F.substring(p, 1, 2), F.substring(digits, 4, 1), F.substring(p, 3, 6)))
        return _into(m, F.when(m.startswith("+"), world).otherwise(home), "0-9")

    return _let(_digits(m), change)


CHANGES = {
    "email": _email,
    "iban": _iban,
    "iso_date": lambda key, m, undo: _date(key, m, undo, "ymd", "-"),
    "day_date": lambda key, m, undo: _date(key, m, undo, "dmy", "."),
    "month_date": lambda key, m, undo: _date(key, m, undo, "mdy", "/"),
    "ssn": _ssn,
    "ip": _ip,
    "card": _card,
    "phone": _phone,
}
#: Kinds that share a permutation: the same day written in another way has the same pseudonym.
SHARED = {"iso_date": "date", "day_date": "date", "month_date": "date"}


def pseudonyms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = EXAMPLE_KEY, undo: bool = False) -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced, and columns n_found, n_changed and n_<kind> (changed values).

    Null texts stay null, with counts of zero. Repeated rows stay, an empty table stays empty; other columns pass
    through unless they have the names of the counts, which replace them. ``undo`` with the same key gives the texts
    back (letter case of e-mail names aside, where a digit and a capital swap places).
    """
    text = F.col(text_col).cast("string")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def change(m):
        kind = F.lit("")
        for name, pattern in reversed(KINDS):
            kind = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
        return F.struct(m.alias("old"), kind.alias("kind"))

    def changed(x):
        out = x["old"]
        for name, _ in KINDS:
            out = F.when(x["kind"] == name, CHANGES[name](_keyed(key, SHARED.get(name, name)), x["old"], undo)).otherwise(out)
        return _let(out, lambda new: F.struct(new.alias("new"), F.when(new != x["old"], x["kind"]).otherwise(F.lit("")).alias("kind")))

    name_found = common.free_name(docs, "__found")
    some = docs.withColumn(name_found, F.when(text.rlike(PATTERN), F.transform(F.transform(found, change), changed)))
    gaps = F.split(text, PATTERN, -1)
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), F.col(name_found).alias("x")), lambda p: F.concat(p["gap"], F.coalesce(p["x"]["new"], F.lit(""))))
    counts = {"n_found": F.coalesce(F.size(name_found), F.lit(0)).cast("long"), "n_changed": _count(name_found, lambda x: x["kind"] != "")}
    counts |= {f"n_{name}": _count(name_found, _is(name)) for name, _ in KINDS}
    out = some.withColumns(counts | {text_col: F.when(F.col(name_found).isNotNull(), F.array_join(pieces, "")).otherwise(text)})
    return out.withColumn("n_found", F.greatest("n_found", F.lit(0).cast("long"))).drop(name_found)


def _is(name: str):
    return lambda x: x["kind"] == name


def _count(found: str, test) -> Column:
    return F.when(F.col(found).isNull(), 0).otherwise(F.size(F.filter(found, test))).cast("long")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pseudonyms(docs).select("doc_id", "text", "n_found", "n_changed", *(f"n_{name}" for name, _ in KINDS))
