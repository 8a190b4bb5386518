"""A trie of conversation prefixes by ROLLUP over positional turn columns.

A conversation's turns are laid out in columns t0, t1, ...; ``GROUP BY node, ROLLUP (t0, t1, ...)`` with
grouping_id aggregates all its prefixes together, and the partial aggregate in every task keeps a first
turn that many share from becoming one task's work.  A conversation longer than a block of columns goes on
in a further block, keyed by the node that the block before ended in.  Sums over subtrees are a second
ROLLUP over the nodes, from the last block back to the first; a block's sum is handed to the node it hangs on.
Rounds follow blocks, so their number is the longest conversation by ``WIDTHS``; later rounds hold long ones only.

A turn is identified by the digest of role and text, a node by the digests on its path.  The ids of the
conversations that end in a node are joined in runs by range first, then digested in order from a sorted stream,
so that no task holds them all.

Defined cases: turns sort by turn (null first), then role and text, so ties and repeated rows have one order
and each is a turn; null role or text is empty; rows without conv_id belong to no conversation and are left
out; a conversation of any number of turns is dealt by range; an empty table has no node, not even a root;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, whole
from factloom.llm.ranked import ranked

#: Columns of the first block and of all further ones.
WIDTHS = (8, 32)
#: Most ids in one run of a node's ends.
IDS = 50_000
#: Turns of a conversation that meet its own record in one join key.
RUN = 10_000
_WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    pieces = F.split(text, _WORD_GAP, -1)  # empty before the first and after the last word only
    return F.size(pieces) - F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) - F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, n, id, words)``: a conversation's n turns in order from 0; ``id`` is the digest of role and text."""
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    ident = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"id": F.unhex(ident), "words": words(F.col("text")).cast("long")})
    return ranked(rows, ["conv_id"], ["turn", "role", "text"]).select("conv_id", F.col("idx").alias("pos"), "n", "id", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation with the first h turns of the first one of its group in place of its own first h."""
    donor, h = (F.col("conv_id") - F.col("conv_id") % group), F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    given = turns.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("donor"), "pos", "id", "words")
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", donor.alias("donor"), h.alias("h"))
    # at most ``group`` conversations meet at most ``most`` turns
    lent = convs.join(given, "donor").filter("pos < h").select("conv_id", "pos", "id", "words")
    sizes = given.groupBy("donor").agg(F.count(F.lit(1)).alias("has"))
    shared = F.least("h", F.coalesce("has", F.lit(0))).alias("shared")
    # a row per run of turns, so that a very long conversation is not one join key
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run")
    base = convs.join(sizes, "donor", "left").select("conv_id", "h", shared, runs)
    own = turns.withColumn("run", F.floor(F.col("pos") / RUN)).join(base, ["conv_id", "run"]).filter("pos >= h")
    return lent.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "id", "words"))


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(width)]


def _rolled(rows: DataFrame, width: int, **sums: Column) -> DataFrame:
    """``(at, depth, turns..., sums...)`` of every prefix of the block: ``at`` is the node the block hangs on, depth counts from it."""
    names = _columns(width)
    rolled = rows.rollup("at", *names).agg(F.grouping_id().alias("gid"), *[c.alias(n) for n, c in sums.items()])
    depth = F.lit(width) - F.bit_count("gid")  # a bit of grouping_id per rolled-up column
    last = F.coalesce(*[F.when(F.col("depth") == i + 1, F.col(n).isNotNull()) for i, n in enumerate(names)], F.lit(True))
    return rolled.withColumn("depth", depth).filter("depth >= 0").filter(last).drop("gid")


def _node(width: int) -> tuple[Column, Column]:
    """The node of a prefix (turns behind it are null) and its parent; the prefix without turns is ``at`` itself."""
    ids = F.array(*[F.hex(F.col(n)["id"]) for n in _columns(width)])

    def reached(depth: Column) -> Column:
        path = F.concat(F.hex("at"), F.array_join(F.slice(ids, F.lit(1), depth), ""))
        return F.when(depth == 0, F.col("at")).otherwise(F.unhex(F.sha2(path, 256)))

    return reached(F.col("depth")), F.when(F.col("depth") > 0, reached(F.greatest(F.col("depth") - 1, F.lit(0))))


def _layout(turns: DataFrame, first: int, width: int) -> DataFrame:
    """``(conv_id, t0, ...)`` for conversations that have turns from ``first`` on."""
    here = turns.filter((F.col("pos") >= first) & (F.col("pos") < first + width))
    cells = F.array_sort(F.collect_list(F.struct("pos", "id", "words")))  # at most ``width``
    row = here.groupBy("conv_id").agg(cells.alias("cells"))
    cell = [F.get("cells", F.lit(i)) for i in range(width)]
    turn = [F.when(c.isNotNull(), F.struct(c["id"].alias("id"), c["words"].alias("words"))).alias(n) for n, c in zip(_columns(width), cell)]
    return row.select("conv_id", *turn)


def _ends(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of ``(node, conv_id)``."""
    dealt = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "least", "part"])

        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (n != node or len(ids) >= IDS):
                    yield done()
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield done()

    parts = dealt.mapInArrow(runs, "node binary, least long, part string").repartition("node").sortWithinPartitions("node", "least")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        for b in batches:
            nodes, found = [], []
            for n, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if sha is not None and n == node:
                    sha.update(b"," + part.encode())
                    continue
                if sha is not None:
                    nodes.append(node)
                    found.append(sha.hexdigest())
                node, sha = n, hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    return parts.mapInArrow(digests, "node binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """One row per node of the conversations ``convs(conv_id)`` with ``turns(conv_id, pos, id, words)``."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    going = kept(convs.join(sizes, "conv_id", "left").select("conv_id", F.lit(b"").alias("at"), F.coalesce("size", F.lit(0)).alias("size")), "trie-convs")
    longest = going.agg(F.max("size")).first()[0]
    blocks, ends, first = [], [], 0
    while longest is not None and (first == 0 or first < longest):
        width = widths[1] if first else widths[0]
        # beyond the first block only conversations with turns there are left, each at the node it came to
        laid = kept(going.join(_layout(turns, first, width), "conv_id", "left" if first == 0 else "inner"), "trie-rows")
        made = _rolled(laid, width, conv_id=F.min("conv_id"), n_convs=F.count(F.lit(1)))
        node, parent = _node(width)
        of_turn = F.coalesce(*[F.when(F.col("depth") == i + 1, F.col(n)["words"]) for i, n in enumerate(_columns(width))])
        made = made.filter("depth > 0" if first else "true").withColumns({"node": node, "parent": parent, "words": of_turn})
        blocks.append((kept(made, "trie-block"), width, first))
        inside = F.least(F.col("size") - first, F.lit(width)).cast("int")
        reached = laid.withColumn("depth", inside).withColumn("node", node).select("conv_id", "node", "size")
        ends.append(kept(reached.filter(F.col("size") <= first + width).select("node", "conv_id"), "trie-ends"))
        going = reached.filter(F.col("size") > first + width).select("conv_id", F.col("node").alias("at"), "size")
        first += width
        if first < longest:
            turns = kept(turns.filter(F.col("pos") >= first), "trie-rest")
    if not blocks:  # an empty table
        blocks = [(_none(convs, widths[0]), widths[0], 0)]
    return _subtrees(convs, blocks, ends)


def _none(convs: DataFrame, width: int) -> DataFrame:
    cells = ", ".join(f"{n} struct<id binary, words long>" for n in _columns(width))
    return convs.sparkSession.createDataFrame([], f"at binary, {cells}, conv_id long, n_convs long, depth int, node binary, parent binary, words long")


def _subtrees(convs: DataFrame, blocks: list[tuple[DataFrame, int, int]], ends: list[DataFrame]) -> DataFrame:
    """The nodes of all blocks with their children, sums over subtrees and ends."""
    carried, out = None, None
    for made, width, first in reversed(blocks):
        children = made.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
        if carried is not None:
            children = children.unionByName(carried.select("node", "n_children")).groupBy("node").agg(F.sum("n_children").alias("n_children"))
        of_node = made.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        more = ["leaves", "saved"]
        if carried is not None:
            of_node = of_node.join(carried.select("node", *more), "node", "left")
        else:
            of_node = of_node.withColumns({m: F.lit(None).cast("long") for m in more})
        own = (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))
        of_node = of_node.withColumns({
            "saved": own + F.coalesce("saved", F.lit(0)),
            "leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("leaves", F.lit(0))),
        })
        of_node = kept(of_node, "trie-nodes")
        sums = _rolled(of_node.drop("depth"), width, n_leaves=F.sum("leaves"), saved_tokens=F.sum("saved"))
        sums = kept(sums.withColumn("node", _node(width)[0]).select("node", "depth", "n_leaves", "saved_tokens"), "trie-sums")
        # the sum of a whole block, its top itself left out, belongs to the node it hangs on
        tops = of_node.filter("depth = 1").groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
        carried = sums.filter("depth = 0").join(tops, "node").select("node", "n_children", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        kept_columns = of_node.select("node", "parent", "conv_id", (F.col("depth") + first).alias("depth"), "n_convs", "n_children")
        rows = kept_columns.join(sums.filter("depth > 0" if first else "true").select("node", "n_leaves", "saved_tokens"), "node")
        out = rows if out is None else out.unionByName(rows)
    nodes = kept(out, "trie-all")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(above, "parent", "left")
    if ends:
        every = ends[0]
        for e in ends[1:]:
            every = every.unionByName(e)
        found = found.join(_ends(every), "node", "left")
    else:
        found = found.withColumn("ends_sha256", F.lit(None).cast("string"))
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefixes(conversations: DataFrame, widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = kept(turns_of(conversations), "trie-turns")
    convs = turns.select("conv_id").distinct()
    return trie(convs, kept(rebuilt(turns), "trie-rebuilt"), widths)
