"""Joins between facts, records, files and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import ordered

MAX_RECORD_SNIPPETS = 4
MAX_PACKET_SNIPPETS = 50


def http_calls(steps: DataFrame, operations: DataFrame) -> DataFrame:
    """Workflow HTTP steps joined to API operations on (method, path); the method defaults to POST."""
    s = steps.filter(F.col("url").startswith("http")).select(
        "workflow", F.upper(F.coalesce(tx.blank_to_null(F.col("method")), F.lit("POST"))).alias("method"), tx.url_path(F.col("url")).alias("path")
    )
    ops = operations.filter(F.col("path").startswith("/")).select("operation", F.upper("method").alias("method"), "path").distinct()
    return s.join(ops, ["method", "path"]).select("workflow", "operation", F.lit("calls").alias("type"))


def ancestors(path: Column) -> Column:
    """Every folder prefix of a path, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def owning_module(files: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """The longest module root that is a folder prefix of each file (NULL when none is).

    Path prefixes become rows, so the prefix test is an equi-join.
    """
    ups = files.select(key, F.explode(ancestors(F.col("path"))).alias("root"))
    hit = ups.join(roots.select("root", "module"), "root").groupBy(key).agg(F.max_by("module", F.length("root")).alias("module"))
    return files.join(hit, key, "left")


def assign_groups(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Group of each record: its own component, else that of the artifact whose path prefixes its
    file (the least such), else ``ungrouped``."""
    named = records.filter("component IS NOT NULL AND component <> ''").select("record_id", F.col("component").alias("group"))
    rest = records.filter("component IS NULL OR component = ''").select("record_id", "file")
    starts = artifacts.filter("repo_path <> ''").select(F.col("repo_path").alias("prefix"), F.col("component").alias("group"))
    starts = starts.groupBy("prefix").agg(F.min("group").alias("group"))
    cuts = F.transform(F.sequence(F.lit(1), F.length("file")), lambda n: F.substring(F.col("file"), F.lit(1), n))
    hits = rest.filter("length(file) > 0").select("record_id", F.explode(cuts).alias("prefix")).join(starts, "prefix")
    hits = hits.groupBy("record_id").agg(F.min("group").alias("group"))
    left = rest.select("record_id").join(hits, "record_id", "left").select("record_id", F.coalesce("group", F.lit("ungrouped")).alias("group"))
    return named.unionByName(left)


def evidence_snippets(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Source lines behind evidence anchors: at most 4 per record, the file's first 80 lines for
    records without any.

    ``evidence(record_id, pos, entry)``, ``files(path, text)``.  Texts stay one row each: an
    anchor meets its file by equality and the range is a slice of the file's lines.
    """
    e = F.trim("entry")
    start = F.coalesce(F.regexp_extract(e, r":(\d+)(?:-\d+)?$", 1).try_cast("int"), F.lit(1))
    # an anchor without an end runs for the longest allowed span
    end = F.coalesce(F.regexp_extract(e, r":\d+-(\d+)$", 1).try_cast("int"), start + tx.MAX_SNIPPET_SPAN)
    a = evidence.select("record_id", "pos", F.regexp_replace(e, r":\d+(?:-\d+)?$", "").alias("path"), start.alias("start_line"), end.alias("end_line"))
    j = a.join(files.select("path", F.split("text", "\n").alias("ls")), "path")
    total = F.size("ls")
    c = tx.clamp_lines(F.col("start_line"), F.col("end_line"), total)
    j = j.select("record_id", "pos", "path", "ls", c.alias("c")).filter("c.end_line >= c.start_line")
    j = j.select(
        "record_id", "pos", "path", "c.start_line", "c.end_line",
        F.array_join(F.slice("ls", F.col("c.start_line"), F.col("c.end_line") - F.col("c.start_line") + 1), "\n").alias("text"),
    ).filter(F.trim("text") != "")
    return ordered.top_per_key(j, ["record_id"], [F.col("pos")], MAX_RECORD_SNIPPETS)


def with_fallback(records: DataFrame, snippets: DataFrame, files: DataFrame) -> DataFrame:
    """Add the first 80 lines of the record's file for records that got no snippet."""
    bare = records.join(snippets.select("record_id").distinct(), "record_id", "left_anti")
    f = bare.select("record_id", F.col("file").alias("path")).join(files, "path")
    ls = F.split("text", "\n")
    f = f.select("record_id", F.lit(-1).cast("bigint").alias("pos"), "path", F.lit(1).alias("start_line"), F.least(F.size(ls), F.lit(80)).alias("end_line"), F.array_join(F.slice(ls, 1, 80), "\n").alias("text"))
    return snippets.unionByName(f.filter(F.trim("text") != ""))


def packet_snippets(snippets: DataFrame, membership: DataFrame, cap: int = MAX_PACKET_SNIPPETS) -> DataFrame:
    """Snippets of each group's records, the first 50 per packet."""
    j = snippets.join(membership, "record_id")
    return ordered.top_per_key(j, ["group"], [F.col("record_id"), F.col("pos")], cap)


def evidence_index(evidence: DataFrame) -> DataFrame:
    """Evidence ids under one running counter per record: plain entries first, then role and
    protocol sections.  ``evidence(record_id, section, label, pos, entry)``."""
    n = ordered.row_index(evidence, ["record_id"], ["section", "pos"], "n")
    num = (F.col("n") - 1).cast("string")
    tag = F.when(F.col("section") == 0, F.lit("#e")).when(F.col("section") == 1, F.concat(F.lit("#role-"), F.col("label"), F.lit("-e"))).otherwise(
        F.concat(F.lit("#"), F.col("label"), F.lit("-e"))
    )
    return n.select(F.concat(F.col("record_id").cast("string"), tag, num).alias("evidence_id"), "record_id", "entry")


def prune_evidence(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims keep only evidence ids that exist: ``claims(claim_id, evidence_id)``."""
    return claims.join(allowed.select("evidence_id").distinct(), "evidence_id", "left_semi")


def overlapping_packets(hits: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets whose components meet those of the hits: ``hits(component)``, ``packets(packet, component)``."""
    return packets.join(hits.select("component").distinct(), "component", "left_semi").select("packet").distinct()


def unmatched(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def findings_by_group(findings: DataFrame, group_files: DataFrame) -> DataFrame:
    """Findings with the groups whose record files contain theirs: ``group_files(group, file)``."""
    return findings.join(group_files.select("group", "file").distinct(), "file")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Added, removed and modified rows between two snapshots, with both states.

    Every other column is compared, NULL-safe.
    """
    cols = [c for c in after.columns if c != key]
    a = after.select(key, F.struct(*cols).alias("now"))
    b = before.select(key, F.struct(*cols).alias("previous"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("previous").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("previous")), "modified")
    return j.withColumn("change", change).filter("change IS NOT NULL")


def name_matches(graphs: DataFrame, workflows: DataFrame, fallback: int) -> DataFrame:
    """Exported graphs of known workflows by normalised name; the first few when none matches."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    g = graphs.withColumn("key", norm(F.col("workflow")))
    names = workflows.select(norm(F.col("name")).alias("key")).filter("key <> ''").distinct()
    hit = g.filter("key <> ''").join(names, "key", "left_semi").select(*graphs.columns)
    # one row says whether anything matched
    none = hit.agg((F.count(F.lit(1)) == 0).alias("__none"))
    few = graphs.orderBy("workflow").limit(fallback).join(F.broadcast(none), F.col("__none")).drop("__none")
    return hit.unionByName(few)


# ---------------------------------------------------------------- fuzzy names
def _segments(s: Column, d: Column) -> Column:
    """``d + 1`` even pieces of a string as (index, start, piece)."""
    n = F.length(s)
    k = F.least(d + 1, F.greatest(n, F.lit(1)))
    at = lambda i: F.floor(i * n / k).cast("int")
    return F.transform(
        F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("i"), at(i).alias("start"), F.substring(s, at(i) + 1, at(i + 1) - at(i)).alias("piece"))
    )


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct name pairs ``(a, b, ratio)`` whose Levenshtein ratio reaches the threshold.

    Exact, without comparing everything: at the allowed distance d, one of d + 1 pieces of
    ``b`` must appear unchanged in ``a``, moved by at most d.  Pieces and placed substrings
    meet by equi-join on (length of b, piece number, piece); survivors are verified.
    """
    a = left.select(F.lower("a").alias("a")).filter("a <> ''").distinct()
    b = right.select(F.lower("b").alias("b")).filter("b <> ''").distinct()
    slack = 1.0 - threshold
    # the largest distance any partner of this name can have
    reach = lambda c: F.floor(F.length(c) * (slack / threshold) + 1e-9).cast("int") if threshold > 0 else F.length(c)
    pieces = b.select("b", F.length("b").alias("lb"), F.explode(_segments(F.col("b"), reach(F.col("b")))).alias("s"))
    pieces = pieces.select("b", "lb", F.col("s.i").alias("i"), F.col("s.piece").alias("piece"))
    shapes = b.select(F.length("b").alias("lb"), reach(F.col("b")).alias("d")).distinct()
    # placed substrings of a for every length b can have
    lengths = shapes.select(F.collect_set(F.struct("lb", "d")).alias("ls")).withColumn("one", F.lit(1))
    # one row holding the distinct lengths, at most as many as the longest name has characters
    spots = a.withColumn("one", F.lit(1)).join(F.broadcast(lengths), "one").select("a", F.explode("ls").alias("l")).select("a", F.length("a").alias("la"), "l.lb", "l.d")
    spots = spots.filter((F.greatest("la", "lb") * slack + 1e-9 >= F.abs(F.col("la") - F.col("lb"))))
    k = F.least(F.col("d") + 1, F.col("lb"))
    at = lambda i: F.floor(i * F.col("lb") / k).cast("int")
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(0), k - 1),
            lambda i: F.transform(
                F.sequence(F.greatest(F.lit(0), at(i) - F.col("d")), F.greatest(F.lit(0), at(i) - F.col("d"), F.least(F.col("la") - (at(i + 1) - at(i)), at(i) + F.col("d")))),
                lambda p: F.struct(i.alias("i"), F.substring(F.col("a"), p + 1, at(i + 1) - at(i)).alias("piece")),
            ),
        )
    )
    placed = spots.select("a", "lb", F.explode(F.array_distinct(cuts)).alias("c")).select("a", "lb", F.col("c.i").alias("i"), F.col("c.piece").alias("piece"))
    pairs = placed.join(pieces, ["lb", "i", "piece"]).select("a", "b").distinct()
    return pairs.withColumn("ratio", tx.levenshtein_ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= threshold - 1e-12)


def match_markers(nodes: DataFrame, markers: DataFrame, policy: str = "slug", threshold: float = 0.7) -> DataFrame:
    """``(node_slug, marker)`` matches under the exact, slug or fuzzy policy."""
    n = nodes.select(F.lower("node_slug").alias("slug"), "node_slug").distinct()
    m = markers.select("marker").distinct()
    bare = F.when(F.col("marker").contains(":"), F.expr("substring(marker, instr(marker, ':') + 1)")).otherwise(F.col("marker"))
    safe = lambda c: F.lower(tx.file_slug(c))
    if policy == "exact":
        keys = m.select("marker", F.explode(F.array(safe(F.col("marker")), F.lower("marker"))).alias("slug")).distinct()
        return n.join(keys, "slug").select("node_slug", "marker").distinct()
    if policy == "fuzzy":
        keys = m.select("marker", F.explode(F.array(F.lower("marker"), F.lower(bare), safe(F.col("marker")))).alias("b")).distinct()
        near = fuzzy_pairs(n.select(F.col("slug").alias("a")), keys, threshold)
        return near.join(keys, "b").join(n, near["a"] == n["slug"]).select("node_slug", "marker").distinct()
    keys = m.select("marker", F.explode(F.array(safe(bare), safe(F.col("marker")))).alias("slug")).distinct()
    equal = n.join(keys, "slug").select("node_slug", "marker")
    # a marker contained in a node name is one of the node's substrings
    squeeze = lambda c: F.regexp_replace(c, "[-_]", "")
    want = m.select("marker", squeeze(safe(bare)).alias("part")).filter("part <> ''")
    small = n.withColumn("compact", squeeze(F.col("slug"))).filter("compact <> ''")
    # only substrings as long as some marker are looked up; the lengths fit in one small row
    lens = want.agg(F.collect_set(F.length("part")).alias("lens")).withColumn("one", F.lit(1))
    sized = small.withColumn("one", F.lit(1)).join(F.broadcast(lens), "one")
    size = F.length("compact")
    spots = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.substring(F.col("compact"), k, n))
    subs = F.flatten(F.transform(F.filter("lens", lambda n: n <= size), spots))
    inside = sized.select("node_slug", F.explode(F.array_distinct(subs)).alias("part")).join(want, "part").select("node_slug", "marker")
    return equal.unionByName(inside).distinct()
