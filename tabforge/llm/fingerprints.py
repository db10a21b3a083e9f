"""Order MinHash fingerprints of documents, in column expressions.

A text's k-mers are runs of K tokens; a token is a word, or one character of a script that is written without spaces.
Every k-mer carries the number of its occurrence, so repeated ones count.  Each of SLOTS slots has a random order of its
own of all numbered k-mers: their hashes fall into SLOTS bins; slot j goes through bin j first and then through the others
as a hash of j and the bin ranks them, and within a bin by hash.  It selects the two least, puts them back in the order in
which they stand in the text and hashes the pair.  Two texts agree in a slot if the same k-mers are least and stand in
the same order, so the share of equal slots falls with edits and with moved passages, unlike MinHash.  One sorted array
serves all orders: a long text's slots read their own bins, a short text's rank the bins that it fills, 64 at most.  The
share of equal slots varies no more than with orders that have nothing in common (tests measure it).

Defined results: a null text counts as empty; empty texts have the same fingerprint, which is like no other; a text of
fewer than K tokens is one k-mer; equal texts have equal fingerprints.  Documents follow each other by doc_id, nulls
first; the last is followed by the first.  Of rows that share a doc_id that with the least text hash is the one that
precedes others as "next document"; each row is fingerprinted itself.  A text may be as long as Spark's arrays (2^28 words).
Columns besides key and text are ignored, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm import common

K, SLOTS = 3, 64

#: Letters of scripts without spaces stand alone as tokens.
_TOKENS = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}]"

#: Places in the text use the low 28 bits of a number: as many as an array can have elements.
_LOW = 28
#: The bin of a number is what its top six bits say.
_BIN = 63 - (SLOTS - 1).bit_length()

#: From tokens w: sorted numbers (hash of the numbered k-mer, place).  Equal k-mers are neighbours once sorted; how many
#: of them stand before is found by halving steps, so that a text of one repeated word costs no more than any other.
_NUMBERED = f"""
element_at(transform(array(transform(%s, x -> xxhash64(x))), h ->
 element_at(transform(array(greatest(size(h) - {K - 1}, least(size(h), 1))), n ->
  element_at(transform(array(sort_array(transform(slice(sequence(0, n), 1, n), i ->
      shiftleft(shiftrightunsigned(xxhash64(h[i], {", ".join(f"get(h, i + {j})" for j in range(1, K))}), {_LOW + 1}), {_LOW}) | least(i, {2**_LOW - 1})))), p ->
   element_at(transform(array(filter(array({", ".join(str(2**j) for j in range(_LOW - 1, -1, -1))}), s -> s <= n)), steps ->
    sort_array(transform(p, (x, i) ->
      shiftleft(shiftrightunsigned(xxhash64(
         shiftrightunsigned(x, {_LOW}),
         IF(shiftrightunsigned(x, {_LOW}) = shiftrightunsigned(coalesce(get(p, i - 1), -1L), {_LOW}),
            aggregate(steps, 0, (o, s) -> IF(shiftrightunsigned(coalesce(get(p, i - o - s), -1L), {_LOW}) = shiftrightunsigned(x, {_LOW}), o + s, o)), 0)
      ), {_LOW + 1}), {_LOW}) | (x & {2**_LOW - 1})))), 1)), 1)), 1)), 1)
"""

#: From the sorted numbers: the place of each bin's first one (and the end), by halving steps.
_STARTS = f"""
element_at(transform(array(filter(array({", ".join(str(2**j) for j in range(_LOW - 1, -1, -1))}), s -> s <= size(__tf_e))), steps ->
 transform(sequence(0, {SLOTS}), b -> IF(b = {SLOTS}, size(__tf_e),
  aggregate(steps, 0, (o, s) -> IF(o + s <= size(__tf_e) AND get(__tf_e, o + s - 1) < b * {2**_BIN}L, o + s, o))))), 1)
"""

#: For each slot the two least numbers of its order; their hashes in the order of their places, hashed to 16 bits.
_SLOTS = f"""
CASE WHEN size(__tf_e) = 0 THEN array() ELSE
element_at(transform(array(filter(sequence(0, {SLOTS - 1}), b -> get(__tf_s, b) < get(__tf_s, b + 1))), full ->
 transform(sequence(0, {SLOTS - 1}), j ->
  element_at(transform(array(IF(get(__tf_s, j + 1) - get(__tf_s, j) >= 2, array(),
      transform(slice(sort_array(transform(filter(full, b -> b <> j), b -> (xxhash64(j, b) & -{SLOTS}L) | b)), 1, 2), x -> CAST(x & {SLOTS - 1} AS INT)))), o ->
   element_at(transform(array(named_struct(
      'a', get(__tf_e, get(__tf_s, IF(get(__tf_s, j) < get(__tf_s, j + 1), j, get(o, 0)))),
      'b', get(__tf_e, CASE WHEN get(__tf_s, j + 1) - get(__tf_s, j) >= 2 THEN get(__tf_s, j) + 1
                            WHEN get(__tf_s, j) < get(__tf_s, j + 1) THEN get(__tf_s, get(o, 0))
                            WHEN get(__tf_s, get(o, 0) + 1) - get(__tf_s, get(o, 0)) >= 2 THEN get(__tf_s, get(o, 0)) + 1
                            ELSE get(__tf_s, get(o, 1)) END))), y ->
    CAST(IF(y.b IS NULL, xxhash64(shiftrightunsigned(y.a, {_LOW})),
       IF((y.a & {2**_LOW - 1}) <= (y.b & {2**_LOW - 1}), xxhash64(shiftrightunsigned(y.a, {_LOW}), shiftrightunsigned(y.b, {_LOW})),
          xxhash64(shiftrightunsigned(y.b, {_LOW}), shiftrightunsigned(y.a, {_LOW})))) & 65535 AS INT)), 1)), 1))), 1) END
"""


def _tokens(text: str) -> str:
    """SQL for the tokens of a text column that isn't null."""
    spaced = f"CASE WHEN {text} RLIKE r'{_TOKENS}' THEN regexp_replace({text}, r'({_TOKENS})', ' $1 ') ELSE {text} END"
    ws = "' \\t\\n\\u000b\\f\\r'"
    return f"element_at(transform(array(btrim({spaced}, {ws})), t -> CASE WHEN t = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(t, '[ \\\\t-\\\\r]+', -1) END), 1)"


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with out: array<int> of SLOTS 16-bit slot values; empty for a text without tokens."""
    had = [F.col(f"`{c}`") for c in df.columns if c != out]
    d = df.select(*had, common.text_or_empty(text_col).alias(_OWN[0]))
    for name, made in ((_OWN[1], F.expr(_own(_NUMBERED % _tokens("__tf_t")))), (_OWN[2], F.expr(_own(_STARTS))), (out, F.expr(_own(_SLOTS)))):
        d = d.select("*", made.alias(name))
    return d.drop(*_OWN)


#: Columns that are made on the way; the blanks at the end keep them apart from any that the input has.
_OWN = ("__tf_t ", "__tf_e ", "__tf_s ")


def _own(sql: str) -> str:
    for name in _OWN:
        sql = sql.replace(name.strip(), f"`{name}`")
    return sql


def as_hex(slots: Column) -> Column:
    """A fingerprint as text: four hex digits for each slot."""
    return F.lower(F.array_join(F.transform(slots, lambda x: F.substring(F.hex(x + 65536), 2, 4)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots, 0 to 1; 1 for two texts without tokens, 0 if only one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).otherwise(same / F.lit(float(SLOTS)))


def followers(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """k, next_k, pred_k of every distinct key (null as the least), with h (least text hash) and n (longest length) of its rows.

    Keys are dealt out by ranges; within a range the next one is found by a window, across ranges from the least key of
    the ranges after, of which there are as many as partitions.
    """
    spark = docs.sparkSession
    text = common.text_or_empty(text_col)
    keys = docs.select(_key(key), F.length(text).cast("long").alias("n"), F.xxhash64(text).alias("h")).groupBy("k").agg(F.max("n").alias("n"), F.min("h").alias("h"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = common.written(keys.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()), "keys")
    in_part = W.partitionBy("part").orderBy("k")
    firsts = dealt.groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    every = W.partitionBy(F.lit(0)).orderBy("part")
    firsts = firsts.withColumn("next_first", F.coalesce(F.lead("first").over(every), F.min("first").over(W.partitionBy(F.lit(0))))).withColumn("last_before", F.coalesce(F.lag("last").over(every), F.max("last").over(W.partitionBy(F.lit(0)))))
    d = dealt.withColumn("__next", F.lead("k").over(in_part)).withColumn("__pred", F.lag("k").over(in_part)).join(firsts, "part")
    d = d.select("k", "n", "h", F.coalesce("__next", "next_first").alias("next_k"), F.coalesce("__pred", "last_before").alias("pred_k"))
    return common.written(d, "followers")


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k")


def with_edited(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(k, key, text, n_chars, edited) of every row and the followers.

    edited: the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document.  Only
    those first halves move to the document before.
    """
    f = followers(docs, key, text_col)
    rows = docs.select(_key(key), common.text_or_empty(text_col).alias("text"))  # the same on both sides, so texts are exchanged once
    own = f.select("k", "pred_k", "h")
    room = f.select(F.col("k").alias("pred_k"), F.col("n").alias("pred_n"))
    lent = rows.join(own.join(room, "pred_k"), "k").filter(F.xxhash64("text").bitwiseXOR(F.col("h")) == 0)  # no equality of sides, so the exchange stays by k
    lent = lent.select(F.col("pred_k").alias("k"), F.substr("text", F.lit(1), (F.col("pred_n") / 2).cast("int")).alias("lent")).groupBy("k").agg(F.min("lent").alias("lent"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    out = rows.join(lent, "k", "left").select("k", F.nullif(F.col("k"), F.lit(-(2**63))).alias(key), "text", n.alias("n_chars"), F.concat(F.substr("text", F.lit(1), (n - half).cast("int")), F.substr(F.coalesce("lent", F.lit("")), F.lit(1), half)).alias("edited"))
    return out, f


def compared(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    pairs, f = with_edited(docs, key, text_col)
    prints = with_fingerprint(with_fingerprint(pairs, "text", "slots"), "edited", "edited_slots")
    prints = prints.select("k", key, "n_chars", F.xxhash64("text").alias("h"), F.sha2("edited", 256).alias("edited_sha256"), "slots", "edited_slots")
    table = common.written(prints, "prints")
    nxt = table.select(F.col("k").alias("next_k"), "h", F.col("slots").alias("next_slots"))
    least = f.select(F.col("k").alias("next_k"), "h", F.col("pred_k").alias("k"))
    nxt = nxt.join(least, ["next_k", "h"]).select("k", "next_slots").dropDuplicates(["k"])
    return table.join(nxt, "k", "left").select(
        key,
        "n_chars",
        "edited_sha256",
        as_hex(F.col("slots")).alias("fingerprint"),
        as_hex(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
