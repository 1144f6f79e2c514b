"""Merkle fixity audit of archive records (op 2).

A record is hashed with sha-256 over its fields.  Records lie in order of an offset; a leaf
covers one offset, and every node covers ``FAN`` children, that is a range of offsets.  Two
replicas are compared from their roots down: only the children of mismatching nodes are looked
at, and only the records of mismatching offsets are compared one by one.  All of it is
DataFrame aggregates and joins; a node gathers ``FAN`` hashes at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage

FAN = 16


def record_hash(fields: list[str]) -> Column:
    """sha-256 over fields as text, each with its length, so that nulls and borders count."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in fields)), 256)


def records(df: DataFrame, offset: str, fields: list[str]) -> DataFrame:
    """(at, sha) of every record."""
    return df.select(F.col(offset).cast("long").alias("at"), record_hash(fields).alias("sha"))


def leaves(recs: DataFrame) -> DataFrame:
    """(k, h): one hash per offset.  Records that share an offset are combined without an order
    among them, by count and sums, so any number of them is added up map-side."""
    pieces = [F.sum(F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return recs.groupBy(F.col("at").alias("k")).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *pieces), 256).alias("h"))


def tree(recs: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Levels of the tree from the leaves to the root, each written to the shared folder.

    Null offsets have a leaf and nodes of their own at every level."""
    out = [cut_lineage(leaves(recs), name)]
    for _ in range(levels):
        up = out[-1].groupBy(F.floor(F.col("k") / FAN).cast("long").alias("k")).agg(
            F.sort_array(F.collect_list(F.struct("k", "h"))).alias("c"))
        joined = F.concat_ws(",", F.transform("c", lambda x: F.concat_ws("=", x["k"].cast("string"), x["h"])))
        out.append(cut_lineage(up.select("k", F.sha2(joined, 256).alias("h")), name))
    return out


def _mismatch(a: DataFrame, b: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes that differ between two replicas, below the mismatching nodes of the level above."""
    if above is not None:
        x = above.select(F.col("k").alias("p"))
        a, b = (t.join(x, F.floor(t["k"] / FAN).cast("long").eqNullSafe(x["p"]), "left_semi") for t in (a, b))
    a, b = a.select("k", F.col("h").alias("ha")), b.select(F.col("k").alias("kb"), F.col("h").alias("hb"))
    both = a.join(b, a["k"].eqNullSafe(b["kb"]), "full")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(F.coalesce("k", "kb").alias("k"))


def audit(primary: DataFrame, replica: DataFrame, offset: str, fields: list[str]) -> DataFrame:
    """(offset, record_sha256, n_primary, n_replica): records whose number differs between replicas.

    A changed record gives a row for either version, a lost or an additional one a row.  Equal
    replicas, two empty ones included, give no row.  Null offsets, null fields and repeated
    records are compared like all others."""
    left, right = records(primary, offset, fields), records(replica, offset, fields)
    reach = [r.agg(F.greatest(F.max(F.abs("at")), F.lit(1)).alias("m")).first()["m"] or 1 for r in (left, right)]
    levels = 1
    while FAN ** levels <= max(reach):
        levels += 1
    a, b = tree(left, levels, "tree"), tree(right, levels, "tree")
    bad = None
    for level in range(levels, -1, -1):
        bad = _mismatch(a[level], b[level], bad)
        if level in (levels, 0):
            bad = cut_lineage(bad, "mismatch")
            if bad.head() is None:
                break
    k = bad.select(F.col("k").alias("p"))
    counted = []
    for recs, mine in ((left, "n_primary"), (right, "n_replica")):
        some = recs.join(k, recs["at"].eqNullSafe(k["p"]), "left_semi")
        counted.append(some.groupBy("at", "sha").agg(F.count(F.lit(1)).alias(mine)))
    x, y = counted[0], counted[1].select(F.col("at").alias("at2"), F.col("sha").alias("sha2"), "n_replica")
    both = x.join(y, x["at"].eqNullSafe(y["at2"]) & (x["sha"] == y["sha2"]), "full").select(
        F.coalesce("at", "at2").alias(offset), F.coalesce("sha", "sha2").alias("record_sha256"),
        F.coalesce("n_primary", F.lit(0)).cast("long").alias("n_primary"), F.coalesce("n_replica", F.lit(0)).cast("long").alias("n_replica"))
    return both.where("n_primary <> n_replica")


def damaged(df: DataFrame, key: str, body: str) -> DataFrame:
    """A replica with faults at places given by a hash of ``key``: changed, lost and doubled records."""
    place = F.coalesce(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), F.lit(""))
    changed = F.when(place == "00", F.concat(F.substring(F.col(body), 2, 1 << 30), F.lit("~"))).otherwise(F.col(body))
    rows = df.withColumn(body, changed).where(place != "01")
    return rows.unionByName(rows.where(place == "02"))
