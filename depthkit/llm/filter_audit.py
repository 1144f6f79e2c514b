"""Filter interaction audit: which filters of a chain remove what, in every order (op 11).

Five failure conditions of a text are bits of one number:

* ``A``: fewer than ``MIN_WORDS`` words; ``B``: distinct words are under half of the words;
* ``C``: letters A-Z are more than 3 % of the code points; ``D``: a character of ``[#$%&*|]``;
* ``E``: the text is identical to that of a row with a smaller id.

``E`` is an existential self-join: a left-semi join on the hash, the exact text and a smaller
id.  Its right side holds each repeated text once, with its smallest id (a partial aggregate
folds copies before they are shuffled), so a group of copies never meets itself.  Texts that
hold at least one row in ``HOT`` (so at most ``HOT`` of them, whatever the size of the table)
are salted on both sides.  The ids of ``E`` are united with those of the other conditions, the
bits of a document are joined by ``bit_or``, and everything else works on the counts of the at
most 32 combinations of bits in each part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit of each filter, in this order.
FILTERS = "ABCDE"
MIN_WORDS = 200
#: Texts with at least this share (one in HOT) of all rows are dealt to SALTS tasks.
HOT = 1000
SALTS = 64
_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of the conditions A to D of a non-null text."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words).cast("long")
    return (F.when(n < MIN_WORDS, 1).otherwise(0)
            + F.when(F.size(F.array_distinct(words)).cast("long") * 100 < n * 50, 2).otherwise(0)
            + F.when(F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 3, 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0))


def repeats(texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (id, hash, text, ...) whose text a row with a smaller id has, too: the existential self-join.

    Rows without an id are nobody's repeat and make nothing a repeat."""
    sizes = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows").alias("total"))
    # at most HOT rows by construction; the other side of the comparison is one row
    hot = F.broadcast(sizes.join(F.broadcast(total), F.col("rows") * HOT >= F.col("total")).where("rows >= 1000").select("hash", F.lit(True).alias("hot")))
    firsts = texts.groupBy("hash", "text").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    every = F.array(*[F.lit(i) for i in range(SALTS)])
    firsts = firsts.join(hot, "hash", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0))))).drop("hot").alias("f")
    rows = texts.join(hot, "hash", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot").alias("t")
    same = [F.col(f"t.{c}") == F.col(f"f.{c}") for c in ("hash", "salt", "text")]
    return rows.join(firsts, [*same, F.col("f.least") < F.col("t.id")], "left_semi").drop("salt")


def _orders() -> Column:
    """Array: for each filter and each set of earlier filters, the (filter_order, step) places where they occur."""
    places: dict[tuple[int, int], list[dict]] = {}
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            places.setdefault((bit, before), []).append({"filter_order": "".join(order), "step": step})
            before |= bit
    rows = [{"bit": b, "before": p, "places": at} for (b, p), at in places.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<bit:int, before:int, places:array<struct<filter_order:string, step:int>>>>")


def combinations(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, bits, docs, good, toxic): documents of each part by their combination of failing filters.

    A row of ``docs`` is a document; null texts are empty, a null part is the empty string.  A
    document is good or toxic if any row of ``labels`` with its id says 1; labels of unknown ids,
    null ids and null labels say nothing."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    # the hash names a row among rows that repeat an id, hence a long one
    hashed = named.withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    others = hashed.select("id", "hash", "part", text_failures(F.col("text")).alias("bits"), F.lit(1).cast("long").alias("n"))
    found = repeats(hashed).select("id", "hash", "part", F.lit(16).alias("bits"), F.lit(0).cast("long").alias("n"))
    rows = others.unionByName(found).groupBy("id", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return rows.join(said, "id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("docs"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, from the counts of ``combinations``.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): 600 rows a part, zeros included; an empty table has no parts."""
    bits, bit, before = F.col("bits"), F.col("o.bit"), F.col("o.before")
    fails, gone = bits.bitwiseAND(bit) != 0, bits.bitwiseAND(before) != 0

    def count(cond: Column, what: str = "docs") -> Column:
        return F.sum(F.when(cond, F.col(what)).otherwise(0))

    n_orders = len(list(permutations(FILTERS)))
    by_set = counts.withColumn("o", F.explode(_orders())).groupBy("part", bit.alias("bit"), before.alias("before")).agg(
        F.first("o.places").alias("places"),
        count(bits.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(bits == bit).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
        # of the orders, a share 1 / (failing filters) has this one first
        F.sum(F.when(fails, F.col("docs") * (F.lit(n_orders) / F.greatest(F.bit_count(bits), F.lit(1))).cast("long")).otherwise(0)).alias("shapley"))
    return by_set.select("*", F.explode("places").alias("at")).select(
        "part", "at.filter_order", "at.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``interactions`` of the ``combinations`` of a table."""
    return interactions(combinations(docs, labels, doc_id, text, part))
