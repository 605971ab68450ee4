"""Personal data by fixed patterns and by bootstrapped contextual extraction.

The fixed patterns give the seeds. The words around a string are its lexical patterns; patterns
and the strings that stand in them form a graph. In each round the strings known so far, seeds and
those accepted before, induce patterns: a pattern is admitted if ``SUPPORT`` of its strings are
known, and ``TRUST`` of all of them, weighted by score. The score of a string that is no seed is the
noisy-or of its admitted patterns; from ``ACCEPT`` on it is known in the next round, where the other
contexts in which it stands can become patterns. Scores are rounded down to thousandths and never
fall, so rounds end where neither strings nor patterns nor their scores change. Accepted strings are reported wherever they stand. Candidates are strings without white
space, marks at their ends left off, of ``SHORTEST`` code points or more with a digit, an @ or an _.

Only DataFrame functions run here; no Python touches a row. Where a match stands is found from
the pieces that the same pattern splits the text into.

Defined results: a null text is empty; every input row gives one row; offsets count code points,
ends are exclusive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

# The contract's patterns, in its order. Possessive repeats and the start conditions
# change no match; they keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
#: Strings that may be identifiers: tokens with a digit, an @ or an _.
TOKEN = r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+"
#: Marks that don't belong to such a token's ends.
EDGE = "\"'()[]{}<>.,;:!?"
SUPPORT, TRUST, ACCEPT = 3, 0.5, 0.8
#: Code points looked at on either side of a string, and the least of a string.
REACH, SHORTEST = 80, 4


def placed(text: Column, pattern: str) -> Column:
    """array of (from, to, s): where each match of the pattern stands."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<from:int,to:int,s:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["s"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("from"), end.alias("to"), pair["s"].alias("s")))).alias("spans"))

    pairs = F.filter(F.arrays_zip(pieces.alias("gap"), found.alias("s")), lambda p: p["s"].isNotNull())
    return F.when(F.size(found) == 0, F.array().cast(f"array<{span}>")).otherwise(F.aggregate(pairs, empty, step, lambda s: s["spans"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def small_parts(s: Column) -> Column:
    """Every dotted part is at most 255, leading zeros or not."""
    return F.forall(F.split(s, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def luhn(s: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        twice = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
        figure = lambda i: F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(figure(i))).otherwise(figure(i)))

    return let(digits(s), lambda d: F.when(F.length(d).between(16, 19), total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<from:int,to:int,s:string>>")
    has = lambda c: F.instr(text, c) > 0
    return {
        "email": F.when(has("@"), placed(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(placed(text, IP), lambda m: small_parts(m["s"]))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), F.filter(placed(text, CARD), lambda m: luhn(m["s"]))).otherwise(none),
        "phone": F.when(has("+"), F.filter(placed(text, PHONE), lambda m: F.length(digits(m["s"])).between(8, 15))).otherwise(none),
    }


def context(text: Column, m: Column) -> Column:
    """The patterns around a span: the two words before it, and one on either side."""
    before = F.lower(F.substring(text, F.greatest(m["from"] - REACH, F.lit(0)) + 1, F.least(m["from"], F.lit(REACH))))
    after = F.lower(F.substring(text, m["to"] + 1, F.lit(REACH)))
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    one, right = F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(after, r"^\S*\s+(\S+)", 1)
    return F.array_compact(F.array(F.when(two != "", F.concat(F.lit("< "), two)), F.when((one != "") & (right != ""), F.concat_ws(" _ ", one, right))))


def trimmed(m: Column) -> Column:
    """The span without marks at its ends."""
    left = F.length(m["s"]) - F.length(F.ltrim(m["s"], F.lit(EDGE)))
    s = F.trim(m["s"], F.lit(EDGE))
    return F.struct((m["from"] + left).alias("from"), (m["from"] + left + F.length(s)).alias("to"), s.alias("s"))


def short(s: Column) -> Column:
    """Very long strings by their digest."""
    return F.when(F.length(s) > 128, F.sha2(s, 256)).otherwise(s)


def scored(edges: DataFrame) -> DataFrame:
    """(s, score) of the strings that are no seeds and end at ``ACCEPT`` or above; edges: (pattern, s, seed)."""
    edges, score = cut(edges), F.coalesce(F.when(F.col("seed"), 1.0).otherwise(F.col("score")), F.lit(0.0))
    known, before = edges.select("s", F.lit(0.0).alias("score")).limit(0), None
    while True:
        now = edges.join(known, "s", "left").select("pattern", score.alias("score"))
        patterns = now.groupBy("pattern").agg(F.avg("score").alias("trust"), F.count_if(F.col("score") >= ACCEPT).alias("support"))
        patterns = patterns.filter((F.col("support") >= SUPPORT) & (F.col("trust") >= TRUST)).select("pattern", "trust")
        # noisy-or of the patterns, each held below 1
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999)))))
        found = edges.filter(~F.col("seed")).join(patterns, "pattern").groupBy("s").agg((F.floor((1 - doubt) * 1000) / 1000).alias("score"), F.count("*").alias("n"))
        # the order in which logarithms are added must not lower a score again
        found = found.join(known.select("s", F.col("score").alias("so_far")), "s", "left").select("s", F.greatest("score", "so_far").alias("score"), "n")
        known = cut(found.filter(F.col("score") >= ACCEPT))
        # strings, the patterns in which they stand and scores: each grows or stays
        state = known.agg(F.count("*"), F.sum("n"), F.sum(F.floor(F.col("score") * 1000 + 0.5))).first()
        if state == before:
            return known
        before = state


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = base_spans(F.col("t"))
    scan = documents.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    scan = scan.select("doc_id", "t", *(c.alias(k) for k, c in own.items()), F.when(F.col("t").rlike("[0-9@_]"), placed(F.col("t"), TOKEN)).otherwise(F.array().cast("array<struct<from:int,to:int,s:string>>")).alias("tokens"))

    def with_context(spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["from"].alias("from"), m["to"].alias("to"), short(F.lower(m["s"])).alias("s"), context(F.col("t"), m).alias("patterns")))

    taken = F.concat(*KINDS)
    free = F.filter(F.transform("tokens", trimmed), lambda m: (F.length(m["s"]) >= SHORTEST) & m["s"].rlike("[0-9@_]"))
    scan = scan.withColumn("taken", taken).withColumn("free", free)
    free = F.filter("free", lambda m: ~F.exists("taken", lambda b: (b["from"] < m["to"]) & (m["from"] < b["to"])))
    scan = scan.withColumn("free", free)
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["from"].alias("from"), m["to"].alias("to")))
    scan = cut(
        scan.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(bare(k).alias(k) for k in KINDS), with_context(F.col("taken")).alias("taken"), with_context(F.col("free")).alias("free"))
    )
    stands = lambda column, seed: scan.select("row", F.explode(column).alias("m")).select("row", "m.from", "m.to", "m.s", "m.patterns", F.lit(seed).alias("seed"))
    edges = stands("taken", True).unionByName(stands("free", False)).select(F.explode("patterns").alias("pattern"), "s", "seed").groupBy("pattern", "s").agg(F.max("seed").alias("seed"))
    accepted = scored(edges).select("s")
    more = stands("free", False).join(accepted, "s").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("context"))

    def named(kind: str) -> Column:
        spans = F.coalesce(F.col(kind), F.array().cast("array<struct<from:int,to:int>>"))
        return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["from"], m["to"]))

    def listed(kinds: list[str]) -> Column:
        return F.concat_ws(",", F.concat(*map(named, kinds)))

    return scan.select("row", "doc_id", *KINDS).join(more, "row", "left").select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(KINDS), 256).alias("base_sha256"),
        listed([*KINDS, "context"]).alias("spans"),
    )
