"""A Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per row.

A row's leaf is the digest of its fields.  Per level, lag and lead columns of fixed offsets, masked by a
node's slot and by the length of its run of at most ``FANOUT`` nodes, supply a node's siblings; the first
child of a run hashes the parent.  The levels are written going up.  Going down, each node takes its
parent's path (the siblings from there to the root), so a row's path joins once per level on the parent,
never on the source: a source with a third of all rows is spread like any other.  Windows hold one run.

Defined cases: null fields hash as ``-``; a null doc_id sorts first and is never tampered with; ties on
doc_id sort by leaf; repeated rows are leaves each; a null source sorts first; texts are hashed whole; an
empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import kept
from factloom.llm.ranked import ranked

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """The byte count, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """A row's leaf, with some fields changed."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def sampled(doc_id: Column) -> Column:
    """Every fifth row, by the crc32 of its id; no row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes of trees with more than one, with ``parent``, ``slot`` and the hashes ``left`` and ``right`` of them in their run."""
    nodes = nodes.filter("n > 1").withColumn("parent", F.floor(F.col("idx") / FANOUT)).withColumn("slot", F.col("idx") % FANOUT)
    run = Window.partitionBy("tree", "parent").orderBy("idx")
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("parent") * FANOUT)
    before = [F.when(F.col("slot") >= k, F.lag("hash", k).over(run)) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < length, F.lead("hash", k).over(run)) for k in range(1, FANOUT)]
    return nodes.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def _parents(nodes: DataFrame) -> DataFrame:
    first = _runs(nodes).filter("slot = 0")
    return first.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), digest(F.col("hash"), F.col("right")).alias("hash"))


def paths(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes(tree, idx, n, hash, ...)`` with ``path``, ``subroot`` and ``root``.

    ``above`` gives ``(tree, path, subroot, root)`` of the trees' tops ``(tree, hash)``; ``path`` holds
    structs of the siblings' hashes to the left and to the right, one per level up to the root.
    """
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(kept(_parents(levels[-1]), "merkle-level"))
        most = -(-most // FANOUT)
    tops = [level.filter("n = 1").select("tree", "hash") for level in levels]
    found = kept(above(reduce(DataFrame.unionByName, tops)), "merkle-tops")
    upper = None
    for level in reversed(levels):
        path = level.filter("n = 1").join(found, "tree")
        if upper is not None:
            siblings = F.array(F.struct("left", "right"))
            reached = upper.select("tree", F.col("idx").alias("parent"), F.col("path").alias("rest"), "subroot", "root")
            below = _runs(level).join(reached, ["tree", "parent"]).withColumn("path", F.concat(siblings, "rest"))
            path = path.unionByName(below.select(path.columns))
        upper = path
    return upper


def _top(tops: DataFrame) -> DataFrame:
    """Paths of the sources' roots in the tree over all sources."""
    order = ranked(tops.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), ["tree"], ["name"])
    none = F.array().cast("array<struct<left string, right string>>")
    whole = paths(order, lambda root: root.select("tree", none.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root")))
    return whole.select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, leaf, subroot, root, path, tampered)`` per row of ``docs``; ``tampered`` is the leaf found on rereading.

    Rereading is played here by lower-casing the texts of ``sampled`` rows.
    """
    again = F.when(sampled(F.col("doc_id")), leaf_of(text=lowered(F.col("text")))).otherwise(F.col("hash"))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # never null, null first
    leaves = docs.withColumn("hash", leaf_of()).select("doc_id", "source", tree.alias("tree"), "hash", again.alias("tampered"))
    order = kept(ranked(kept(leaves, "merkle-leaves"), ["tree"], ["doc_id", "hash"]), "merkle-ranked")
    return paths(order, _top).select("doc_id", "source", F.col("hash").alias("leaf"), "subroot", "root", "path", "tampered")


def verified(rows: DataFrame) -> DataFrame:
    """``manifest`` rows with the digest of their proof and the root folded from the leaf found on rereading."""
    siblings = F.transform("path", lambda level: F.concat(level["left"], level["right"]))
    rows = rows.withColumns({"proof_sha256": F.sha2(F.concat_ws("", siblings), 256), "folded_root": folded(F.col("tampered"), F.col("path"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
