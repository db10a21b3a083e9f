"""Personal data by patterns and by bootstrapped contexts, in column expressions and aggregates.

Base kinds (email, ip, card, phone) are found by expression.  They seed a graph of lexical patterns and instances: a
pattern is what stands around an identifier (the two words before it, or one on each side), an instance is an
identifier's text, and candidates are other words with a digit or an at sign, and runs of numbers joined by spaces,
dashes, dots or brackets, as the base kinds allow them.  In rounds, a pattern's confidence in a kind is the lower Wilson
bound of the share of its evidence that speaks for the kind: base finds count 1, for their kind or against it;
candidates that rounds before have found count with their score; others count UNSEEN against the kind if they have its
shape and 1 if they don't.  An instance's score is the confidence of its best pattern, and a pattern isn't supported by
instances that it found itself, so evidence travels from context to context but not in a circle of one.  Candidates that
stand in a pattern of high confidence are reported as ctx_<kind>.  Base spans always stay.

Offsets are code points, ends exclusive.  Contexts are read from the text between a match and the two before it or the one
after, so a text is read a fixed number of times, however long and full of numbers; only the test that candidates are apart
from base spans grows with the product of their numbers in one text.  Defined results: a null text counts as empty and has
no spans; repeated rows each give a row and count as one instance of a pattern; of two kinds of equal confidence the
later in alphabetical order holds; columns other than key and text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"ctx_{k}" for k in BASE))
#: Rounds of scoring, the confidence from which a pattern finds identifiers, and the Wilson bound's deviate.
ROUNDS, CONFIDENT, DEVIATE = 3, 0.6, 1.96
#: What an unseen candidate of a kind's shape counts against the kind.
UNSEEN = 0.15

#: Java forms of the base expressions.  Runs are taken whole (possessively) and entered only at their start or where the
#: last match ended, which finds the same leftmost matches in linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or an at sign.
_CANDIDATE = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
#: A word of digits, dots, dashes and brackets; two or more of them with spaces (and lone separators) between.
_NUMBER = r"[(]*+[0-9]++(?:[().-]++[0-9]++)*+[).-]*+(?=[,;:!?\"'>\]}]*+(?:[ \t-\r]|$))"
_JOINED = r"(?<![^ \t-\r])[\"'(<\[{+]*+" + _NUMBER + r"(?:\x20++(?:[().-]++\x20++)?+" + _NUMBER + r")++[^ \t-\r]*+"
#: What opens a candidate without being part of it; the bracket of an area code is part of it.
_OPENING = r"^(?:[\"'(<\[{]*?(?=\([0-9]+\)[\x20().-]*[0-9])|[\"'(<\[{]*)"


def matches(text: Column, pattern: str, around: bool = False) -> Column:
    """Array of (start, end, value, before, after) of all matches of a Java expression in a text: found ones and what lies
    between alternate, and starts are running sums of their lengths, taken in two levels so that many matches stay cheap.
    before and after (lower case, null unless around): the two words before a match and the one after it."""
    p = F.lit(pattern)
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    none = F.lit(None).cast("string")

    def place(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(found)), F.transform(found, F.length), lambda g, m: g + m)
        joined = lambda *parts: F.concat(*[F.coalesce(F.get(x, i), F.lit("")) for x, i in parts])
        before = lambda i: _before(joined((gaps, i - 2), (found, i - 2), (gaps, i - 1), (found, i - 1), (gaps, i))) if around else none
        after = lambda i: _after(joined((gaps, i + 1), (found, i + 1), (gaps, i + 2))) if around else none

        def starts(s: Column) -> Column:
            side = F.ceil(F.sqrt(F.size(s))).cast("int")

            def by_block(w: Column) -> Column:
                sums = F.transform(F.sequence(F.lit(0), w - 1), lambda i: add(F.slice(s, i * w + 1, w)))
                return common.let(sums, lambda b: F.transform(found, lambda m, i: _span(add(F.slice(b, F.lit(1), (i / w).cast("int"))) + add(F.slice(s, (i / w).cast("int") * w + 1, i % w + 1)), m, before(i), after(i))))

            return common.let(side, by_block)

        return common.let(steps, starts)

    return common.let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, common.let(F.split(text, pattern, -1), lambda gaps: place(found, gaps))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")))


def _span(end: Column, value: Column, before: Column, after: Column) -> Column:
    return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))


def _before(text: Column) -> Column:
    """The last two words of what stands before a match, lower-cased."""
    return F.lower(F.regexp_extract(text, r"(?:^|[ \t-\r])([^ \t-\r]++[ \t-\r]++[^ \t-\r]++)[ \t-\r]*+$", 1))


def _after(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^[^ \t-\r]{0,3}[ \t-\r]+([^ \t-\r]+)", 1))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second one from the right counts twice, less 9 above 9."""
    value = lambda d, i: common.let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda x: common.let(F.ltrim(x, F.lit("0")), lambda z: (F.length(z) < 3) | (F.length(z) == 3) & (z <= "255")))
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "card":
        return common.let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, value, before, after) of the base kinds by start, then kind as listed."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>")

    def of(kind: str, rank: int) -> Column:
        return F.transform(F.filter(matches(text, PATTERNS[kind], True), lambda m: _valid(kind, m["value"])), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), *[m[c].alias(c) for c in ("value", "before", "after")]))

    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    found = [F.when(has[k], of(k, i)).otherwise(none) if k in has else of(k, i) for i, k in enumerate(BASE)]
    return F.when(F.rlike(text, F.lit("[0-9@]")), F.array_sort(F.concat(*found))).otherwise(none)


def shapes(value: Column) -> Column:
    """Which kinds a text has the shape of, a bit for each as listed in BASE: looser than the kinds themselves."""
    digits, plain = F.length(F.regexp_replace(value, "[^0-9]+", "")), ~F.rlike(value, F.lit("[^0-9+().\\x20-]"))
    bits = [F.contains(value, F.lit("@")), F.rlike(value, F.lit(r"^[0-9]+[.][0-9]+[.][0-9]+")), plain & digits.between(12, 19), plain & digits.between(6, 15)]
    return sum((F.when(b, 2**i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def scanned(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (of the row), key, base (spans) and occ: identifiers and candidates with the words around them."""
    d = docs.select(key, common.text_or_empty(text_col).alias("t"))
    d = d.withColumn("base", base_spans(F.col("t")))

    def trimmed(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], _OPENING, 0))
        core = F.rtrim(F.substr(m["value"], lead + 1), F.lit(".,;:!?\"')>]}"))
        return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.length(core)).alias("end"), F.lit(None).cast("string").alias("kind"), core.alias("value"), m["before"].alias("before"), m["after"].alias("after"))

    # A candidate is dropped if it overlaps a base span, a single word also if a run of numbers holds it.
    apart = lambda c, spans: ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    d = d.withColumn("joined", F.filter(F.transform(matches(F.col("t"), _JOINED, True), trimmed), lambda c: (F.length(c["value"]) >= 3) & apart(c, "base")))
    words = F.filter(F.transform(matches(F.col("t"), _CANDIDATE, True), trimmed), lambda c: (F.length(c["value"]) >= 3) & apart(c, "base") & apart(c, "joined"))
    fields = ("start", "end", "kind", "value", "before", "after")
    known = F.transform("base", lambda b: F.struct(*[b[c].alias(c) for c in fields]))
    placed = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "kind")], F.xxhash64(x["value"]).alias("inst"), F.when(x["kind"].isNull(), shapes(x["value"])).alias("shape"), x["before"].alias("before"), x["after"].alias("after"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,inst:bigint,shape:int,before:string,after:string>>")
    occ = F.when(F.rlike("t", F.lit("[0-9@]")), F.transform(F.concat(known, "joined", words), placed)).otherwise(none)
    d = d.withColumn("occ", occ)
    return d.select(F.monotonically_increasing_id().alias("uid"), key, F.transform("base", lambda b: F.struct(*[b[c].alias(c) for c in ("start", "rank", "end", "kind")])).alias("base"), "occ")


def _edges(table: DataFrame) -> DataFrame:
    """uid, start, end, kind, inst, shape and pattern: one row per occurrence and pattern."""
    o = table.select("uid", F.explode("occ").alias("o")).select("uid", "o.*")
    last = F.regexp_extract("before", r"([^ \t-\r]+)$", 1)
    patterns = F.filter(F.array(F.when(F.col("before") != "", F.concat(F.lit("b "), "before")), F.when((last != "") & (F.col("after") != ""), F.concat(F.lit("a "), last, F.lit(" _ "), "after"))), lambda p: p.isNotNull())
    return o.select("uid", "start", "end", "kind", "inst", "shape", F.explode(patterns).alias("pattern"))


def patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence: scores of the pattern-instance graph after the rounds, as a written table."""
    with common.scratch(edges.sparkSession):
        graph = common.written(edges.groupBy("pattern", "inst").agg(F.max("kind").alias("kind"), F.max("shape").alias("shape")), "graph")
        unknown = F.col("kind").isNull()
        like = [F.count_if(unknown & (F.col("shape").bitwiseAND(2**i) > 0)).alias(f"like_{k}") for i, k in enumerate(BASE)]
        # Only patterns that an identifier or a found candidate stands in are ever scored; the join with support sees to it.
        total = common.written(graph.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.count_if(unknown).alias("unseen"), *like), "totals")
        seeds = graph.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("s"), F.lit(0).cast("bigint").alias("found"), F.count("*").alias("own"))
        z2, out = DEVIATE * DEVIATE, None
        for step in range(rounds):
            support = seeds
            if out is not None:
                strong = out.filter(F.col("confidence") >= CONFIDENT)
                reached = graph.filter(unknown).select("pattern", "inst").join(strong, "pattern").groupBy("inst").agg(F.max(F.struct("confidence", "kind", "pattern")).alias("best"))
                back = graph.filter(unknown).select("pattern", "inst").join(reached, "inst").filter("best.pattern <> pattern")
                found = back.groupBy("pattern", F.col("best.kind").alias("kind")).agg(F.sum("best.confidence").alias("s"), F.count("*").alias("found"), F.lit(0).cast("bigint").alias("own"))
                support = seeds.unionByName(found).groupBy("pattern", "kind").agg(F.sum("s").alias("s"), F.sum("found").alias("found"), F.sum("own").alias("own"))
            shaped = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"like_{k}")) for k in BASE])
            rest = F.greatest(F.lit(0), F.col("unseen") - shaped) + UNSEEN * F.greatest(F.lit(0), shaped - F.col("found"))
            n = F.col("s") + (F.col("seeds") - F.col("own")) + rest
            share = F.col("s") / F.col("n")
            bound = (share + z2 / (2 * F.col("n")) - DEVIATE * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
            scored = support.join(total, "pattern").withColumn("n", n)
            out = common.written(scored.select("pattern", "kind", bound.alias("confidence")), "patterns", outer=step + 1 == rounds)
    return out


def find(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, base and spans: arrays of (start, end, kind) of each row by start, then kind as listed in KINDS."""
    table = common.written(scanned(docs, key, text_col), "scanned")
    edges = _edges(table)
    strong = patterns(edges).filter(F.col("confidence") >= CONFIDENT).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("pattern", "best.confidence", "best.kind")
    hit = edges.filter("kind IS NULL").drop("kind").join(strong, "pattern").groupBy("uid", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    rank = F.array_position(F.array(*[F.lit(k) for k in BASE]), F.col("best.kind")).cast("int") + len(BASE) - 1
    found = hit.groupBy("uid").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("ctx_"), "best.kind").alias("kind"))).alias("more"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))))
    return table.select("uid", key, "base").join(found, "uid", "left").select(key, "base", every.alias("spans"))


def digest(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, number of spans of each base kind, SHA-256 of the base spans, the string of all spans, as kind:start:end, and
    n_ctx, the number of those that contexts have found."""
    of = lambda kind: lambda x: x["kind"] == kind
    s = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return find(docs, key, text_col).select(key, *[F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(s("base"), 256).alias("base_sha256"), s("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_ctx"))
