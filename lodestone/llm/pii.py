"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Addresses (e-mail, IPv4, IPv6), numbers, dates and secrets are found by pattern and validated (check digits, ranges, the calendar). Each is
then permuted within its own format: digits stay digits, letters stay letters of their case, separators stay, check
digits are right again, addresses and dates stay valid. The permutation is a bijection set by the key alone, so equal
values get equal pseudonyms in every document, and different values different ones.

A string is split into two halves; in each round one half is shifted, place by place and within the alphabet of each
place, by a keyed hash (SHA-256) of the other. IPv4 addresses and dates are numbers and are split into two digits of a
suitable base; dates walk the cycle until they fall within the calendar's range again.

Secrets and addresses have no greatest length: a secret is taken to its end, dots inside it included (a JWT, say), if one of
its parts has 12 characters, whatever the name before it begins with; passwords with the marks in them, which are permuted among themselves;
an IBAN is taken at its country's length.

DataFrame operations only, and no shuffle: each text is rewritten where it is read.

Rows: null text stays null, empty text stays empty; every row is taken for itself, so repeated rows get equal results;
other columns pass through untouched, whatever they are called; an empty table gives an empty result.

The key is an argument without a default. The registered queries take it from the session's setting spark.lodestone.pii.key; where that is
unset, from a random number drawn once a driver process: values are then linked within the process only.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import let

#: The setting of the key, and the key of this process where it is unset.
SETTING, _DRAWN = "spark.lodestone.pii.key", secrets.token_hex(32)
ROUNDS = 8
#: Halves over this length are hashed once, all others at each place.
LONG = 128
#: Dates that are permuted: from 1900-01-01, so many days.
DAYS = 73_049

#: Countries by the length of their IBAN. Others are matched at any length that the check digits accept.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    """The pattern of whole IBANs of a length, in one piece or in groups of four: a word behind them is none of theirs."""
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|(?: [A-Z0-9]{{4}}){{{groups}}}{f' [A-Z0-9]{{{rest}}}' if rest else ''})(?![A-Za-z0-9])"


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\."
#: Marks that a password may hold; they are permuted among themselves.
MARKS = "!#$%&*?@^~"
_TOP = r"[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: The patterns of what is looked for, in order of precedence. Repeats without a bound are possessive: these
#: take no stack. The second form of a domain gives labels back, as many as a name can have (127), where the last is no top level.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:(?:{_LABEL}(?=[A-Za-z0-9]))++{_TOP}|(?:{_LABEL}){{1,127}}{_TOP})",
    "secret": rf"(?i:(?:passwd|password|passphrase)[\"']?[ \t]{{0,4}}[=:][ \t]{{0,4}}[\"']?)(?=[A-Za-z0-9+/_.{MARKS}-]*?[A-Za-z0-9+/_{MARKS}-]{{12}})[A-Za-z0-9+/_{MARKS}-]++(?:\.[A-Za-z0-9+/_{MARKS}-]++)*+|(?i:(?:token|secret|api[_-]?key|access[_-]?key)[\"']?[ \t]{{0,4}}[=:][ \t]{{0,4}}[\"']?)(?=[A-Za-z0-9+/_.-]*?[A-Za-z0-9+/_-]{{12}})[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+|\bAKIA[0-9A-Z]{{16}}\b",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?![A-Za-z0-9]))",
    "card": r"(?<![0-9])(?<![0-9][.,-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])(?![.,-][0-9])",
    "phone": r"(?<![0-9+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])|(?<![0-9(+-])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:]|\.[0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9])|(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9/])",
}
#: The first digits of issued card numbers.
ISSUERS = "^(?:4|5[0-8]|6|3[04-9]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)"
#: All in one. Groups that the card pattern refers to are counted from its start: no pattern before it has any.
ANY = "|".join(PATTERNS.values())
#: What every match has: a character that the patterns but one require, or the start of that one (letters alone are a key).
MAYBE = "[0-9@=:]|AKIA"


def _hash(key: str, kind: str, *parts: Column) -> Column:
    """48 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _shift(key: str, kind: str, half: Column, other: Column, t: Column) -> Column:
    """half, each place moved within its alphabet by a hash of the other half."""

    def place(c: Column, i: Column, seen: Column) -> Column:
        h = _hash(key, kind, t, i + 1, seen)
        code = F.ascii(c)

        def within(first: int, n: int) -> Column:
            return F.char((code - first + h % n) % n + first)

        if kind == "ipv6":
            return F.when(c.rlike("[0-9a-f]"), F.lower(F.conv(((F.conv(c, 16, 10).cast("long") + h % 16) % 16).cast("string"), 10, 16))).otherwise(c)
        if kind == "secret":
            mark = F.instr(F.lit(MARKS), c)
            c = F.when(mark > 0, F.substring(F.lit(MARKS), (((mark - 1 + h) % len(MARKS)) + 1).cast("int"), F.lit(1))).otherwise(c)
        return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

    # of a long half each place hashes a digest, so that the work is in proportion to the length
    seen = F.when(F.length(other) > LONG, F.sha2(other, 256)).otherwise(other)
    moved = let(seen, lambda v: F.array_join(F.transform(F.split(half, ""), lambda c, i: place(c, i, v)), ""))
    return F.when(F.length(half) == 0, half).otherwise(moved)


def permute_text(key: str, kind: str, s: Column) -> Column:
    """ASCII letters and digits of s permuted, each within its alphabet, all else in place."""

    def turn(st: Column, t: Column) -> Column:
        even = t % 2 == 0
        a = F.when(even, _shift(key, kind, st["a"], st["b"], t)).otherwise(st["a"])
        b = F.when(even, st["b"]).otherwise(_shift(key, kind, st["b"], st["a"], t))
        return F.struct(a.alias("a"), b.alias("b"))

    def halves(v: Column) -> Column:
        u = F.floor(F.length(v) / 2).cast("int")
        return F.struct(F.substring(v, F.lit(1), u).alias("a"), F.substring(v, u + 1, F.length(v)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), let(s, halves), turn, lambda st: F.concat(st["a"], st["b"]))


def permute_number(key: str, kind: str, n: Column, high: int, low: int) -> Column:
    """A permutation of the numbers below high * low."""
    start = let(n, lambda v: F.struct(F.floor(v / low).cast("long").alias("a"), (v % low).cast("long").alias("b")))

    def turn(st: Column, t: Column) -> Column:
        even = t % 2 == 0
        a = F.when(even, (st["a"] + _hash(key, kind, t, st["b"])) % high).otherwise(st["a"])
        b = F.when(even, st["b"]).otherwise((st["b"] + _hash(key, kind, t, st["a"])) % low)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda st: st["a"] * low + st["b"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(shape: Column, chars: Column, wanted: str = "[0-9]") -> Column:
    """shape with the places that match wanted taken from chars, in order."""
    start = F.struct(F.lit("").alias("out"), chars.alias("rest"))

    def put(st: Column, i: Column) -> Column:
        c = F.substring(shape, i, 1)
        take = c.rlike(wanted)
        out = F.concat(st["out"], F.when(take, F.substring(st["rest"], 1, 1)).otherwise(c))
        rest = F.when(take, F.substring(st["rest"], F.lit(2), F.length(st["rest"]))).otherwise(st["rest"])
        return F.struct(out.alias("out"), rest.alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), start, put, lambda st: st["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit as the check digit."""

    def total(v: Column) -> Column:
        def add(sum_: Column, i: Column) -> Column:
            d = F.substring(v, i, 1).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return sum_ + F.when((F.length(v) - i) % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    return let(digits, total)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of letters and digits read as a number (A is 10)."""

    def remainder(v: Column) -> Column:
        def add(r: Column, i: Column) -> Column:
            code = F.ascii(F.substring(v, i, 1))
            return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    return let(s, remainder)


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    issued = lambda x: x.rlike(ISSUERS)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(32)), permute_text(key, "card", body), lambda x, _: F.when(issued(x), x).otherwise(permute_text(key, "card", x)))
    made = let(walk, lambda v: F.concat(v, ((10 - luhn_sum(F.concat(v, F.lit("0"))) % 10) % 10).cast("string")))
    # a run of one digit is filler, not a number
    return F.when((luhn_sum(d) % 10 == 0) & issued(d) & ~d.rlike("^(.)\\1*$"), _refill(m, made))


def _iban(key: str, m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    made = let(permute_text(key, "iban", rest), lambda v: F.concat(country, F.lpad((98 - _mod97(F.concat(v, country, F.lit("00")))).cast("string"), 2, "0"), v))
    valid = (F.length(s) >= 15) & (_mod97(F.concat(rest, F.substring(s, 1, 4))) == 1)
    return F.when(valid, _refill(m, made, "[A-Z0-9]"))


def _phone(key: str, m: Column) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    d = _digits(rest)
    return F.when(F.length(_digits(m)).between(8, 15), F.concat(code, _refill(rest, permute_text(key, "phone", d))))


def _ssn(key: str, m: Column) -> Column:
    def valid(d: Column) -> Column:
        area = F.substring(d, 1, 3)
        return ~(area.isin("000", "666") | (area >= "900") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000"))

    d = _digits(m)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(32)), permute_text(key, "ssn", d), lambda x, _: F.when(valid(x), x).otherwise(permute_text(key, "ssn", x)))
    return F.when(valid(d), _refill(m, walk))


def _ip(key: str, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    p = permute_number(key, "ip", n, 1 << 16, 1 << 16)
    made = F.aggregate(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), F.struct(p.alias("p"), F.array().cast("array<string>").alias("out")), lambda st, s: F.struct(st["p"].alias("p"), F.concat(st["out"], F.array((F.floor(st["p"] / F.pow(F.lit(2.0), s.cast("double"))).cast("long") % 256).cast("string"))).alias("out")), lambda st: F.array_join(st["out"], "."))
    return F.when(F.forall(parts, lambda x: x <= 255), made)


def _ipv6(key: str, m: Column) -> Column:
    """Hexadecimal digits permuted, groups and the gap in place; capitals if it had any. A gap stands for two groups at least, so up to six are written."""
    groups = F.size(F.array_remove(F.split(m, ":"), ""))
    made = permute_text(key, "ipv6", F.lower(m))
    return F.when((~m.contains("::") & (groups == 8)) | (m.contains("::") & groups.between(2, 6)), F.when(m.rlike("[A-F]"), F.upper(made)).otherwise(made))


def _date(key: str, m: Column) -> Column:
    kind = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    iso = F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    first = F.lit("1900-01-01").cast("date")
    day = F.date_diff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), first).cast("long")
    step = lambda x: permute_number(key, "date", x, 271, 271)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(16)), step(day), lambda x, _: F.when(x < DAYS, x).otherwise(step(x)))
    write = lambda made: F.when(kind == "yyyy-MM-dd", F.date_format(made, "yyyy-MM-dd")).when(kind == "dd.MM.yyyy", F.date_format(made, "dd.MM.yyyy")).otherwise(F.date_format(made, "MM/dd/yyyy"))
    return F.when(day.between(0, DAYS - 1), let(F.date_add(first, walk.cast("int")), write))


def _email(key: str, m: Column) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permute_text(key, "email", local), F.lit("@"), domain)


def _secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, f"[A-Za-z0-9+/_.{MARKS}-]*$", 0)
    prefix = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    plain = F.when(value.startswith("AKIA") & (prefix == ""), F.concat(F.lit("AKIA"), permute_text(key, "secret", F.substring(value, 5, 16))))
    return F.coalesce(plain, F.concat(prefix, permute_text(key, "secret", value)))


_RULES = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "ipv6": _ipv6, "date": _date}


def _named(kind: str, value: Column) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$".replace("\\b", "")


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, None) or _DRAWN


def pseudonyms(match: Column, key: str) -> Column:
    """struct(kind, value) for a match of ANY; kind and value are null where validation fails."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, rule in reversed(_RULES.items()):
        named = _named(kind, rule(key, match))
        out = F.when(match.rlike(_whole(kind)), named).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "_pii") -> DataFrame:
    """docs with text_col rewritten, and a column found_col (replaced, if docs have one): array of struct(kind, match, value)
    of what was replaced. key: secret; who has it can undo the pseudonyms.
    """
    # everything else rides along in one struct: no name of a column can clash with those used here
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # the card pattern's own groups follow none: regexp_extract_all takes group 0
    seen = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    df = df.withColumn("matches", F.coalesce(seen, F.array().cast("array<string>")))
    found = F.transform("matches", lambda m: F.struct(m.alias("match"), pseudonyms(m, key).alias("p")))
    df = df.withColumn("found", F.when(F.size("matches") > 0, found)).withColumn("gaps", F.when(F.size("matches") > 0, F.split("text", ANY, -1)))
    filled = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("found", i)["p"]["value"], F.get("found", i)["match"], F.lit(""))))
    text = F.when(F.size("matches") > 0, F.array_join(filled, "")).otherwise(F.col("text"))
    replaced = F.transform(F.filter("found", lambda x: x["p"].isNotNull()), lambda x: F.struct(x["p"]["kind"].alias("kind"), x["match"].alias("match"), x["p"]["value"].alias("value")))
    pii = F.coalesce(replaced, F.array().cast("array<struct<kind:string,match:string,value:string>>"))
    others = [c for c in docs.columns if c != found_col]
    return df.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in others), pii.alias(found_col))
