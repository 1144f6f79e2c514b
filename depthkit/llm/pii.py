"""Personal data by weak supervision, in DataFrame functions only (op 1).

Base spans come from fixed patterns with checks (octets of an address, Luhn digits, numbers of
digits).  Looser patterns propose more spans.  Labelers vote on every proposal: patterns, gazetteers
(top-level domains, issuer digits, key prefixes) and context (cue words nearby).  Expectation-
maximisation over the table of vote patterns (at most 3 ** labelers rows) estimates how reliable
each labeler is and the probability of each pattern.  These soft labels train a final
classifier, naive Bayes over hashed shape and neighbour features, whose table has at most
FEATURES * BUCKETS rows.  Proposals that it accepts, and that some pattern votes for, are added.

Positions count code points.  A match's position is the sum of the lengths of what precedes it,
from the pieces between matches; the sums run in a window over one document's matches.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage

KINDS = ["email", "ip", "card", "phone", "secret", "national_id"]
#: Base patterns.  Possessive forms and anchors at the start of a run only save backtracking;
#: each finds what its plain form finds (see the tests).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns for proposals.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]]|\x20at)\x20?\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\x20dot)\x20?\x20?[A-Za-z]{2,10})",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|pwd|token|secret|api_key|apikey)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{8,}[\"']?)",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9A-Za-z.])[0-9]++(?:[.,:/-][0-9]++)*+(?![0-9A-Za-z])",
}
#: A text without any of these has neither a base span nor a proposal.
POSSIBLE = r"(?i)[0-9@]|[\x20(\[]dot[\x20)\]]|(?:password|passwd|pwd|token|secret|api_key|apikey)\x20?[=:]"
DOMAINS = ["com", "net", "org", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "eu"]
CUES = r"(?i)(e-?mail|mail|phone|tel|call|mobile|fax|contact|card|visa|credit|ip|server|host|password|passwd|pwd|token|secret|key|login|ssn|social)"
AGAINST = r"(?i)(version|v\.|license|licence|by-nc|by-sa|by|page|chapter|section|figure|table|price|\$|€|%|no\.)"
#: Buckets of each feature of the final classifier.
BUCKETS = 4096
FEATURES = 5
#: A proposal is added from this probability on.
ACCEPT = 0.9


def _luhn(digits: Column) -> Column:
    steps = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (F.lit(1) + i % 2))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (F.when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15)).otherwise(True))


def numbered(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, text) of every row, written so that row numbers stay; texts only where a digit,
    an @ or a written-out one makes a span possible."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                                 F.when(t.rlike(POSSIBLE), t).alias("text")), "pii")


def matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(row, kind, start, end, match, before, after) of all matches, leftmost and not overlapping per kind."""
    t = F.col("text")
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("m"), F.split(t, p, -1).alias("p"))
                      for k, p in patterns.items()))
    kinds = rows.where("text is not null").select("row", F.inline(found)).where(F.size("m") > 0)
    side = F.struct(F.length("x.p").alias("lp"), F.length("x.m").alias("lm"), F.col("x.m").alias("match"),
                    F.substring_index(F.expr("right(x.p, 40)"), "\n", -1).alias("before"))
    each = kinds.select("row", "kind", F.posexplode(F.arrays_zip("m", "p")).alias("i", "x")).select("row", "kind", "i", side.alias("s")).select("row", "kind", "i", "s.*")
    w = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum(F.col("lp") + F.coalesce("lm", F.lit(0))).over(w) - F.coalesce("lm", F.lit(0))
    each = each.withColumn("start", start.cast("long"))
    return each.where("match is not null").select("row", "kind", "start", (F.col("start") + F.col("lm")).alias("end"), "match", "before")


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the base patterns' matches that pass their checks."""
    return matches(rows, BASE).where(_valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end")


# ---- weak supervision ------------------------------------------------------------------------
def votes(proposals: DataFrame) -> DataFrame:
    """Proposals with ``votes``: a digit per labeler (1 personal, 0 not, 2 abstains)."""
    kind, m, before = F.col("kind"), F.col("match"), F.col("before")
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    vote = lambda yes, no=F.lit(False): F.when(yes, "1").when(no, "0").otherwise("2")
    domain = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    labelers = [
        vote(kind.isin("email", "national_id", "secret"), kind == "number"),  # patterns
        vote(m.rlike(r"^AKIA[0-9A-Z]{16}$") | m.rlike(r"[=:]"), (kind == "number") & (digits < 7)),
        vote(kind.isin("card", "phone"), (kind == "number") & m.rlike(r"^[0-9]+(?:[.,][0-9]+)?$") & (digits < 16)),
        vote((kind == "email") & domain.isin(DOMAINS), (kind == "email") & ~domain.isin(DOMAINS)),  # gazetteers
        vote((kind == "card") & m.rlike(r"^[3-6]"), (kind == "card") & ~m.rlike(r"^[3-6]")),
        vote(m.rlike(r"(?i)^(?:AKIA|password|passwd|pwd|token|secret|api)"), kind == "number"),
        vote(before.rlike(CUES + r"[^A-Za-z0-9]{0,4}$")),  # context
        vote(F.lit(False), before.rlike(AGAINST + r"[^A-Za-z0-9]{0,4}$")),
        vote(digits.between(9, 19) & (kind != "number"), digits < 3),
    ]
    return proposals.withColumn("votes", F.concat(*labelers))


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 40) -> dict[str, float]:
    """Probability of being personal data for each vote pattern, by expectation-maximisation.

    ``patterns``: (votes, count), one row per pattern that occurs.  Each labeler has a rate of
    true votes in either class, with a prior that it is better than chance."""
    k = len(patterns[0][0]) if patterns else 0
    prior, right = 0.3, [[0.8, 0.8] for _ in range(k)]  # right[l][y]: rate of vote y, given class y and a vote
    post: dict[str, float] = {}
    for _ in range(rounds):
        for v, _ in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for c, (r0, r1) in zip(v, right):
                if c != "2":
                    a += math.log(r1 if c == "1" else 1 - r1)
                    b += math.log(r0 if c == "0" else 1 - r0)
            post[v] = 1 / (1 + math.exp(max(-500.0, min(500.0, b - a))))
        total = sum(n for _, n in patterns) or 1
        prior = min(0.95, max(0.05, sum(n * post[v] for v, n in patterns) / total))
        for l in range(k):
            ones = sum(n * post[v] for v, n in patterns if v[l] == "1"), sum(n * post[v] for v, n in patterns if v[l] != "2")
            zeros = sum(n * (1 - post[v]) for v, n in patterns if v[l] == "0"), sum(n * (1 - post[v]) for v, n in patterns if v[l] != "2")
            right[l] = [min(0.99, max(0.51, (zeros[0] + 8) / (zeros[1] + 10))), min(0.99, max(0.51, (ones[0] + 8) / (ones[1] + 10)))]
    return post


def features(proposals: DataFrame) -> DataFrame:
    """(row, kind, start, f): bucket numbers of a proposal's shape, length and neighbours."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("match", "[0-9]", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    left = F.lower(F.regexp_extract("before", r"([^\s]*)\s*$", 1))
    cues = F.concat_ws(",", F.col("kind"), F.regexp_extract(F.lower("before"), CUES + r"[^a-z0-9]{0,4}$", 1))
    each = [shape, F.col("kind"), F.concat(F.col("kind"), F.lit(":"), F.length("match").cast("string")), left, cues]
    bucket = [F.lit(i * BUCKETS).cast("long") + F.pmod(F.xxhash64(x), F.lit(BUCKETS)) for i, x in enumerate(each)]
    return proposals.withColumn("f", F.array(*bucket))


def added_spans(rows: DataFrame, base: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(row, kind, start, end) of proposals that the final classifier accepts and no base span overlaps."""
    proposals = cut_lineage(features(votes(matches(rows, LOOSE))), "proposals")
    counted = [(r[0], r[1]) for r in proposals.groupBy("votes").count().orderBy("votes").collect()]  # 3 ** labelers at most
    spark = rows.sparkSession
    says, p = zip(*(sorted(reliabilities(counted).items()) or [("", 0.0)]))
    post = spark.createDataFrame(pa.table({"votes": pa.array(says, pa.string()), "p": pa.array(p, pa.float64())}))  # as Arrow, which needs no Python worker
    soft = proposals.join(F.broadcast(post), "votes")
    seen = soft.select("p", F.explode("f").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    total = soft.agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    rate = F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 1))
    table = seen.crossJoin(F.broadcast(total)).select("f", rate.alias("weight"), (F.log(F.col("all_yes") + 1) - F.log(F.col("all_no") + 1)).alias("prior"))
    key = ["row", "kind", "start", "end", "votes"]  # the table has a row per hashed feature at most, whatever the input
    scored = proposals.select(*key, F.explode("f").alias("f")).join(F.broadcast(table), "f").groupBy(*key).agg(
        (F.sum("weight") / F.lit(math.sqrt(FEATURES)) + F.first("prior")).alias("score"))
    pattern_says = F.substring("votes", 1, 3).contains("1")
    chosen = scored.where(pattern_says & (F.col("score") >= math.log(accept / (1 - accept))) & F.col("kind").isin(KINDS))
    b = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    free = chosen.join(b, (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    return free.select("row", "kind", "start", "end")


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(numbered rows, all spans (row, kind, start, end, base))."""
    rows = numbered(df, doc_id, text)
    base = cut_lineage(base_spans(rows), "spans")
    more = added_spans(rows, base)
    return rows, base.withColumn("base", F.lit(True)).unionByName(more.withColumn("base", F.lit(False)))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added (added ones), base_sha256, spans (all) of every row.

    Null and empty texts have no spans (base_sha256 is that of the empty string).  Rows are kept
    apart by a row number, so repeated rows and null ids get a result each."""
    rows, found = spans(df, doc_id, text)
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    per = found.groupBy("row").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]), F.count(F.when(~F.col("base"), 1)).alias("n_added"),
        F.sort_array(F.collect_list(F.struct(_order(F.col("kind")).alias("o"), "start", "end", "base", label.alias("l")))).alias("all"))
    join = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["l"]))
    counts = [*(f"n_{k}" for k in KINDS[:4]), "n_added"]
    per = per.select("row", *counts, join(F.filter("all", lambda x: x["base"])).alias("b"), join(F.col("all")).alias("s"))
    out = rows.select("row", "doc_id").join(per, "row", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
                      F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("s", F.lit("")).alias("spans"))


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``df`` with every span in ``text`` replaced by its kind, as in <email>.

    Overlapping spans become one, named after the first.  Texts without spans, nulls included,
    stay as they are; ``n_chars`` follows the text where the column exists."""
    held = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()), "redact")
    rows = held.select(F.col("__row").alias("row"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike(POSSIBLE))
    base = cut_lineage(base_spans(rows), "spans")
    found = base.unionByName(added_spans(rows, base))
    w = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isles = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("isle", F.sum("new").over(w))
    isles = isles.groupBy("row", "isle").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("kind", F.struct("start", "kind")).alias("k"))
    per = isles.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "k"))).alias("__cuts")).withColumnRenamed("row", "__row")
    t, cuts = F.col(text), F.col("__cuts")
    last = lambda i: F.when(i > 0, F.element_at(cuts, F.when(i > 0, i).otherwise(F.lit(1)))["e"]).otherwise(F.lit(0))
    parts = F.transform(cuts, lambda x, i: F.concat(
        F.substr(t, (last(i) + 1).cast("int"), (x["s"] - last(i)).cast("int")), F.lit("<"), x["k"], F.lit(">")))
    tail = F.substr(t, (F.element_at(cuts, -1)["e"] + 1).cast("int"))
    new = F.when(cuts.isNull(), t).otherwise(F.concat(F.concat_ws("", parts), tail))
    out = held.join(per, "__row", "left").withColumn(text, new)
    if n_chars and n_chars in df.columns:
        out = out.withColumn(n_chars, F.when(cuts.isNull(), F.col(n_chars)).otherwise(F.length(text).cast(df.schema[n_chars].dataType)))
    return out.select(*df.columns)
