"""Exact dedup by skew-safe combining.

Texts are equal when identical after every run of the six ASCII white-space characters became one
space; null counts as empty.  Three stages combine groups, each by the digest *and* the full content:

1. rows of one task (map-side part of the first aggregation),
2. rows of one (digest, salt), the salt being taken from the task, so that a text held by a third of
   all rows meets in ``SALTS`` places instead of one,
3. the at most ``SALTS`` salt winners of a text.

Rows find their group by digest alone; where contents share a digest (``rival``) they find it by content.

Defined cases: a repeated row (same id, equal text) stays once; rows without an id lose to rows with
one; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import kept, whole

SALTS = 16


def normalised(text: Column) -> Column:
    # a lone space stays as it is, so only the other runs need replacing
    return F.regexp_replace(whole(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(rows: DataFrame) -> DataFrame:
    """``(digest, keep_id, group_size, rival)`` per distinct content of ``rows(doc_id, digest, body)``.

    ``rival`` holds the content where its digest has several, else null.
    """
    salted = rows.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "body")
    salted = salted.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = salted.repartition("digest").groupBy("digest", "body")
    met = met.agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    contents = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return met.select("digest", "keep_id", "group_size", F.when(contents > 1, F.col("body")).alias("rival"))


def exact_groups(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, digest.

    ``digest`` may be any function of the normalised text; results do not depend on its collisions.
    """
    body = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    body = body.select("doc_id", digest(F.col("body")).alias("digest"), "body")
    won = kept(winners(body), "exact-winners")
    return _members(body, won)


def _members(body: DataFrame, won: DataFrame) -> DataFrame:
    rivals = won.filter("rival IS NOT NULL")
    found = _meet(body.select("doc_id", "digest"), won.filter("rival IS NULL").drop("rival"), ["digest"])
    if not rivals.isEmpty():  # contents that share a digest: never with sha256, but rows must not be lost
        clash = body.join(rivals.select("digest").distinct(), "digest", "left_semi")
        found = found.unionByName(_meet(clash, rivals.withColumnRenamed("rival", "body"), ["digest", "body"]).select(found.columns))
    copies = found.select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return copies.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest",
    )


def _meet(rows: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    # repeated rows are counted first, so that one of them can stay
    return rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("copies")).join(won, keys)


def drop_copies(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    body = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    won = kept(winners(body.select("doc_id", digest(F.col("body")).alias("digest"), "body")), "exact-winners")
    marked = docs.withColumn("__body", normalised(F.col("text"))).withColumn("__digest", digest(F.col("__body")))
    stay = won.select(
        F.coalesce("keep_id", F.lit(0)).alias("__id"), F.isnull("keep_id").alias("__no_id"),
        F.col("digest").alias("__won"), F.col("rival").alias("__rival"),
    )
    same = (
        (F.coalesce("doc_id", F.lit(0)) == F.col("__id")) & (F.isnull("doc_id") == F.col("__no_id"))
        & (F.col("__digest") == F.col("__won"))
    )
    if won.filter("rival IS NOT NULL").isEmpty():
        marked, stay = marked.drop("__body"), stay.drop("__rival")
    else:
        same = same & (F.isnull("__rival") | (F.col("__rival") == F.col("__body")))
    found = marked.join(stay, same, "left_semi")
    again = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "__digest", normalised(F.col("text"))).orderBy("text")
    return found.withColumn("__n", F.row_number().over(again)).filter("__n = 1").select(docs.columns)
