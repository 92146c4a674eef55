"""Secret scan with multipart credential linking.

Strong finds stand alone: an assignment to a secret's name, an AKIA access identifier, a long run of hexadecimal digits. Weak finds mean
nothing alone: a name or number of an account (ident), a value behind a secret-like name that is not among the strong ones (keyed), a mixed
token without any name (bare), an address of a service (endpoint). They are reported where complementary parts stand together.

Parts stand together if they are in the same scope, the text between two blank lines, and at most REACH code points lie between them.
This interval join is a sweep: the parts of a document are ordered by start, and running maxima and minima in both directions give each part
the nearest identifier, secret and endpoint before and behind it, so that no pairs are made, however many parts a scope has.

- ident is reported beside a secret (assign, hex, keyed, bare);
- keyed beside an identifier (access, ident) or an endpoint;
- bare beside an identifier;
- endpoint beside an identifier and a secret.

A weak part that overlaps a strong one is left out, and a bare token that overlaps any other part.

DataFrame operations only. Positions are prefix sums of the lengths of matches and of what lies between them, in blocks of the square root of their
number. Texts are read once and never shuffled; of documents with weak parts only the parts are, by row.

Rows: null and empty texts have no finds; every row is taken for itself, so repeated rows, and rows that repeat an id or have none, get a result
each; other columns are left out, whatever they are called; an empty table gives an empty result. Parts that start at the same place are ordered
by kind as in KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, settled

#: Code points between parts that belong together.
REACH = 400
#: The strong patterns, as their contract names them; shorter finds are dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The weak patterns, and what parts scopes. They have no look-around, so that every engine reads them alike.
IDENT = r"""(?i:access_?key_?id|client_?id|key_?id|account_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{4,}"""
KEYED = r"""(?i:secret_?access_?key|secret_?key|client_?secret|private_?key|access_?key|auth_?key|passphrase|pwd|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
BARE = r"[A-Za-z0-9+/=_-]{20,}"
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@%&=+-]+|(?i:hostname|host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""
BREAK = r"\n[\x20\x09\x0D]*\n"
KINDS = ("assign", "access", "hex", "ident", "keyed", "bare", "endpoint", "break")
RANK = {k: i for i, k in enumerate(KINDS)}
#: A find: where it starts, its kind's place in KINDS, where it ends (exclusive).
FIND = "struct<start:bigint,rank:int,end:bigint>"


def prefix_sums(lengths: Column) -> Column:
    """Running sums of a non-empty array of long, each by at most two sums over the square root of its size."""
    add = lambda a, x: a + x
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), add)

    def within(v: Column, w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda b: total(F.slice(v, b * w + 1, w)))

        def at(sums: Column) -> Column:
            def upto(_: Column, i: Column) -> Column:
                return let(F.floor(i / w).cast("int"), lambda b: total(F.slice(sums, F.lit(1), b)) + total(F.slice(v, b * w + 1, i - b * w + 1)))

            return F.transform(v, upto)

        return let(blocks, at)

    return let(lengths, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: within(v, w)))


def located(text: Column, pattern: str, kind: str, good=None) -> Column:
    """array of FIND: the matches of a pattern, from left to right, without overlap; good: which of the matched strings stay."""
    none = F.array().cast(f"array<{FIND}>")

    def finds(matches: Column) -> Column:
        lengths = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit")), lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long"))

        def cut(ends: Column) -> Column:
            made = F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(RANK[kind]).alias("rank"), F.get(ends, i).alias("end"), m.alias("m")))
            kept = made if good is None else F.filter(made, lambda x: good(x["m"]))
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

        return F.when(F.size(matches) > 0, let(prefix_sums(lengths), cut)).otherwise(none)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), finds)).otherwise(none)


def _mixed(m: Column) -> Column:
    """Digits, capitals and small letters: no word, and no row of one sign."""
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def finds(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of strong finds, in order) and weak (array of weak finds and scope breaks, empty unless both an identifier and
    a secret, or a keyed value and an endpoint, are in the document)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    df = df.withColumn("base", F.array_sort(F.concat(located(text, ASSIGN, "assign", long_value), located(text, ACCESS, "access"), located(text, HEX, "hex"))))
    df = df.withColumns({k: located(text, p, k) for k, p in (("ident", IDENT), ("keyed", KEYED), ("endpoint", ENDPOINT))})
    named = (F.size("ident") > 0) | F.exists("base", lambda x: x["rank"] == RANK["access"])
    df = df.withColumn("bare", F.when(named, located(text, BARE, "bare", _mixed)).otherwise(F.array().cast(f"array<{FIND}>")))
    secret = (F.size("keyed") + F.size("bare") > 0) | F.exists("base", lambda x: x["rank"] != RANK["access"])
    linkable = (named & secret & (F.size("ident") + F.size("keyed") + F.size("bare") + F.size("endpoint") > 0)) | ((F.size("keyed") > 0) & (F.size("endpoint") > 0))
    weak = F.when(linkable, F.concat("ident", "keyed", "bare", "endpoint", located(text, BREAK, "break"))).otherwise(F.array().cast(f"array<{FIND}>"))
    return df.select("doc_id", "base", weak.alias("weak"))


def linked(events: DataFrame) -> DataFrame:
    """row, start, rank, end of the weak finds to report, of events (row, start, rank, end: strong and weak finds and breaks)."""
    rank = F.col("rank")
    of = lambda *kinds: rank.isin(*(RANK[k] for k in kinds))

    def around(*keys: str) -> tuple:
        ahead = Window.partitionBy(*keys).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
        back = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        return ahead, back

    ahead, back = around("row")
    overlaps = lambda kinds: F.coalesce(F.max(F.when(kinds, F.col("end"))).over(ahead) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(kinds, F.col("start"))).over(back) < F.col("end"), F.lit(False))
    strong, others = overlaps(of("assign", "access", "hex")), overlaps(of("assign", "access", "hex", "ident", "keyed", "endpoint"))
    scope = F.sum(F.when(rank == RANK["break"], 1).otherwise(0)).over(ahead)
    marked = events.withColumns({"_strong": strong, "_others": others, "scope": F.coalesce(scope, F.lit(0))})
    covered = (of("ident", "keyed", "endpoint") & F.col("_strong")) | (of("bare") & F.col("_others"))
    parts = marked.where(~covered & (rank != RANK["break"])).drop("_strong", "_others")
    ahead, back = around("row", "scope")

    def near(*kinds: str) -> Column:
        before = F.col("start") - F.max(F.when(of(*kinds), F.col("end"))).over(ahead)
        behind = F.min(F.when(of(*kinds), F.col("start"))).over(back) - F.col("end")
        return F.coalesce(before <= REACH, F.lit(False)) | F.coalesce(behind <= REACH, F.lit(False))

    parts = parts.withColumns({"_id": near("access", "ident"), "_secret": near("assign", "hex", "keyed", "bare"), "_end": near("endpoint")})
    wanted = (of("ident") & F.col("_secret")) | (of("keyed") & (F.col("_id") | F.col("_end"))) | (of("bare") & F.col("_id")) | (of("endpoint") & F.col("_id") & F.col("_secret"))
    return parts.where(wanted).select("row", "start", "rank", "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of strong finds, in order), all (array of all finds to report, in order)."""
    each = settled(finds(docs).withColumn("row", F.monotonically_increasing_id()))
    alone = each.where(F.size("weak") == 0).select("doc_id", "base", F.col("base").alias("all"))
    some = each.where(F.size("weak") > 0)
    events = some.select("row", F.inline(F.concat("base", "weak")))
    more = linked(events).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{FIND}>"))))
    return alone.unionByName(some.join(more, "row", "left").select("doc_id", "base", both.alias("all")))


def written(found: Column) -> Column:
    """kind:start:end of finds, joined by commas."""
    kind = lambda r: F.get(F.array(*map(F.lit, KINDS)), r)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kind(x["rank"]), x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak finds reported)."""
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == RANK[k])).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_linked"))
