"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 16 hex digits of the SHA-256 of the parts joined by ::."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16))


def fingerprint(path: Column, birth: Column) -> Column:
    return F.concat(path, F.lit("||"), birth)


def fingerprint_path(fp: Column) -> Column:
    """The path of a fingerprint: up to the first ||, or (older form) up to the last colon."""
    return F.when(fp.contains("||"), F.substring_index(fp, "||", 1)).otherwise(F.regexp_replace(fp, ":[^:]*$", ""))


def fingerprint_birth(fp: Column) -> Column:
    """What follows the first ||, or (older form) the last colon."""
    return F.when(fp.contains("||"), F.substring(fp, F.length(F.substring_index(fp, "||", 1)) + 3, F.length(fp))).otherwise(F.element_at(F.split(fp, ":"), -1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extname(path: Column) -> Column:
    """With its dot; a name that starts with its only dot has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def iso_timestamp(text: Column) -> Column:
    """Both forms in use, as a timestamp: with T and Z, or with a space."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def needs_review(text: Column) -> Column:
    """How often @@@ marks stand at a line's start, after a comment sign, or at a line's end."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*@@@|(?://|#)\s*@@@|@@@\s*$"), F.lit(0)))


def cyclomatic(text: Column) -> Column:
    """One plus the branch words and operators."""
    return 1 + F.size(F.regexp_extract_all(text, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])"), F.lit(0)))


def nesting(text: Column) -> Column:
    """The greatest depth of braces."""

    def step(st: Column, c: Column) -> Column:
        depth = st["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("d"), F.greatest(st["m"], depth).alias("m"))

    signs = F.split(F.regexp_replace(text, "[^{}]", ""), "")
    return F.aggregate(signs, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda st: st["m"])


def loc(text: Column) -> Column:
    """Lines that are neither empty nor a comment."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(//.*|\*.*|/\*.*)?$")))


def balanced(text: Column) -> Column:
    """Names of the bracket kinds that do not come in equal numbers."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    kinds = {"braces": "{}", "parentheses": "()", "brackets": "[]"}
    return F.array_compact(F.array(*(F.when(count(p[0]) != count(p[1]), F.lit(k)) for k, p in kinds.items())))


def template_variables(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))


def fill_template(text: Column, values: Column) -> Column:
    """text with {{name}} replaced by values (a map); unknown names stay."""
    return F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def escape_toml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rewrite_path(path: Column, old: str, new: str) -> Column:
    """The path with its prefix swapped."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def search_text(*parts: Column) -> Column:
    """Parts joined by blanks, at most 500 characters (the index takes no more)."""
    return F.substring(F.concat_ws(" ", *parts), 1, 500)


def trailing_id(text: Column) -> Column:
    """The number after the last colon, else null."""
    return F.element_at(F.split(text, ":"), -1).try_cast("long")


def json_or_raw(text: Column, path: str) -> Column:
    """A field of a JSON text, or the text itself where it is none."""
    return F.coalesce(F.get_json_object(text, path), text)


def band(score: Column, low: float, high: float) -> Column:
    return F.when(score < low, "low").when(score <= high, "medium").otherwise("high")


def purpose(name: Column) -> Column:
    """A file's purpose by its name, the first rule that holds."""
    rules = [("test|spec", "Verifies behaviour"), ("index|main|app", "Entry point"), ("config|settings", "Holds configuration"), ("util|helper|common", "Shared helpers"), ("type|schema|model", "Describes data"), ("route|api|server", "Serves requests"), ("store|state", "Keeps state"), ("parse", "Parses text")]
    out = F
    for pattern, says in rules:
        out = out.when(name.rlike(f"(?i)({pattern})"), says)
    return out.otherwise(F.concat(F.lit("Provides "), F.regexp_replace(name, r"\.[^.]*$", "")))


def metadata_distance(a: Column, b: Column) -> Column:
    """Share of the common keys of two maps whose values differ."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    other = F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.when(F.size(keys) > 0, F.size(other) / F.size(keys)).otherwise(0.0)


def sealed(text: Column, key: Column) -> Column:
    """text encrypted with a key of 32 characters (AES-GCM, a new vector each time), as base 64."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def opened(text: Column, key: Column) -> Column:
    """What sealed() hid; null with another key."""
    return F.try_aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


#: What a score is said to mean, from a bound on (fragility: up to a bound).
MEANINGS = {
    "reachability": ((0.95, "Excellent — nearly all dependencies resolved"), (0.8, "Good — most dependencies resolved"), (0.5, "Moderate — significant gaps remain"), (None, "Poor — majority of dependencies unresolved")),
    "stability": ((0.8, "High confidence in integration success"), (0.5, "Moderate confidence — some uncertainty"), (None, "Low confidence — integration may be unreliable")),
    "fragility": ((0.05, "Minimal post-integration breakage risk"), (0.15, "Low risk — minor issues possible"), (0.3, "Moderate risk — careful testing required"), (None, "High risk — significant breakage likely")),
}


def meaning(score: str, value: Column) -> Column:
    """What a value of a score (a key of MEANINGS) is said to mean; null for null."""
    *bounds, (_, last) = MEANINGS[score]
    out = F.when(value.isNull(), None)
    for bound, text in bounds:
        out = out.when(value <= bound if score == "fragility" else value >= bound, text)
    return out.otherwise(last)
