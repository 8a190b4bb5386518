"""URL filter: rules, then a ratio of two character language models.

Rules decide first; the longest that fits wins.  All urls that rules accept or reject teach one
variable-order Markov model each.  A byte's probability mixes the context orders from none to
``ORDER``: ``p_k = (n(context, byte) + MASS p_(k-1)) / (n(context) + MASS)``, so an order speaks as far as its
context was seen.  A url without a rule gets the difference of both log-likelihoods per byte; above
the calibrated threshold it is allowed.  The threshold least confuses the two classes on the learned urls
themselves, each scored as if it had not been learned.

Everything is done once per distinct url.  The counts are a table that grows with the corpus and is
never broadcast: urls are dealt in blocks of about ``SIZE``, a block asks for the counts of the contexts it
holds, and meets just those.  A context that all blocks hold is a hot key of that join, which adaptive
execution splits.  All joins here are merge joins by hint: Spark judges a table that Python makes by the size of its
input, and a written one by its packed files, and would broadcast what is many times as large in the driver.

Defined cases: a null url counts as empty; one without ``://`` has empty host and path, fits no rule and is judged
by the models as its text; if rules teach only one class or none, the models have nothing
to compare and allow; ids may be null or repeated; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept

ORDER, SIZE, MASS, STEP, REACH = 5, 1024, 4.0, 256, 4096
ALLOW, BLOCK = "allow", "block"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``; rules are (``host/path``, verdict)."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


class Text:
    """Bytes of many urls in one array, with hashed keys of contexts and of contexts with their byte."""

    def __init__(self, urls: list[str]):
        raw = [u.encode() + b"\0" for u in urls]
        pad = b"\0" * ORDER
        flat = np.frombuffer(b"".join(pad + r for r in raw), np.uint8).astype(np.uint64)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        starts = np.cumsum(self.sizes + ORDER) - self.sizes
        self.url = np.repeat(np.arange(len(raw)), self.sizes)
        at = np.repeat(starts, self.sizes) + np.arange(len(self.url)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.orders, h = [], np.full(len(at), _MIX)
        for k in range(ORDER + 1):
            if k:
                h = (h ^ (h >> np.uint64(31))) * _MIX + flat[at - k] + np.uint64(k)
            self.orders.append((_key(h), _key(h * _MIX + flat[at] + np.uint64(257))))

    def keys(self) -> Iterator[np.ndarray]:
        return (k for pair in self.orders for k in pair)

    def mean_log(self, counts: Callable[[np.ndarray], np.ndarray], own: np.ndarray) -> np.ndarray:
        """Log-likelihood per byte of each url; ``own`` says how many copies of it to take out of the counts."""
        less = own[self.url].astype(float)
        p = np.full(len(self.url), 1 / 256)
        for context, gram in self.orders:
            p = (np.maximum(counts(gram) - less, 0) + MASS * p) / (np.maximum(counts(context) - less, 0) + MASS)
        return np.bincount(self.url, np.log(np.minimum(p, 1.0)), minlength=len(self.sizes)) / self.sizes


def _key(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) * _MIX).view(np.int64)


def learn(urls: DataFrame) -> DataFrame:
    """``(key, allow, block)``: counts over all of ``urls(url, n, verdict)``, combined in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, n = b.column(0).to_pylist(), np.asarray(b.column(1), np.float64)
            blocked = np.array([v == BLOCK for v in b.column(2).to_pylist()], bool)
            for at in range(0, len(urls), SIZE):
                text, few = Text(urls[at : at + SIZE]), slice(at, at + SIZE)
                keys, place = np.unique(np.concatenate(list(text.keys())), return_inverse=True)
                copies, bad = np.tile(n[few][text.url], 2 * ORDER + 2), np.tile(blocked[few][text.url], 2 * ORDER + 2)
                sums = [np.bincount(place, copies * of, minlength=len(keys)).astype(np.int64) for of in (~bad, bad)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["key", "allow", "block"])

    rows = urls.select("url", "n", "verdict").mapInArrow(run, "key long, allow long, block long")
    return rows.groupBy("key").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def differences(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``(url, diff, held)`` of ``urls(url, n, verdict, part)``; ``held`` leaves the url itself out of its class."""

    def ask(rows: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(list(Text(rows.column("url").to_pylist()).keys())))
        return pa.table({"part": pa.array(np.full(len(keys), rows.column("part")[0].as_py(), np.int64)), "key": keys})

    asked = urls.select("url", "part").groupBy("part").applyInArrow(ask, "part long, key long").join(counts.hint("merge"), "key")

    def meet(rows: pa.Table, model: pa.Table) -> pa.Table:
        urls, n = rows.column("url").to_pylist(), np.asarray(rows.column("n")).astype(np.int64)
        text, verdict = Text(urls), np.array(rows.column("verdict").to_pylist(), object)
        order = np.argsort(np.asarray(model.column("key")))
        keys = np.asarray(model.column("key"))[order]
        logs = {}
        for name in (ALLOW, BLOCK):
            values = np.asarray(model.column(name)).astype(float)[order]

            def count(asked: np.ndarray) -> np.ndarray:
                if not len(keys):
                    return np.zeros(len(asked))
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                return np.where(keys[at] == asked, values[at], 0.0)

            logs[name] = text.mean_log(count, np.zeros(len(n))), text.mean_log(count, n * (verdict == name))
        diff, held = (logs[ALLOW][i] - logs[BLOCK][i] for i in (0, 1))
        return pa.table({"url": rows.column("url"), "diff": diff, "held": held})

    return urls.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(meet, "url string, diff double, held double")


def threshold(learned: DataFrame) -> float:
    """Of ``learned(held, verdict, n)``: where the share of wrongly judged allowed urls plus that of blocked
    ones is least; the middle of ties."""
    bins = F.greatest(F.lit(-REACH), F.least(F.lit(REACH - 1), F.floor(F.col("held") * STEP))).cast("int").alias("bin")
    rows = learned.groupBy("verdict", bins).agg(F.sum("n").alias("n")).collect()  # at most 4 * REACH rows
    seen = np.zeros((2, 2 * REACH))
    for r in rows:
        seen[int(r.verdict == BLOCK), r.bin + REACH] = r.n
    allow, block = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    wrong = np.r_[0, np.cumsum(allow)] + np.r_[np.cumsum(block[::-1])[::-1], 0]  # cut below bin i
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return (float(best[(len(best) - 1) // 2] + best[len(best) // 2]) / 2 - REACH) / STEP


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(page_id, host, path, rule, verdict, diff)`` per row of ``pages(page_id, url)``; rules are
    (``host/path``, ``allow`` or ``block``)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", "n", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    urls = kept(urls.select("url", "n", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")), "urls")
    size = urls.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == ALLOW).alias("a"), F.count_if(F.col("verdict") == BLOCK).alias("b")).first()
    if size.a and size.b:
        counts = kept(learn(urls.filter("verdict IS NOT NULL")), "url-counts")
        part = F.pmod(F.xxhash64("url"), F.lit(max(1, size.n // SIZE))).alias("part")
        found = kept(differences(urls.select("url", "n", "verdict", part), counts), "url-differences")
        cut = threshold(urls.filter("verdict IS NOT NULL").join(found.hint("merge"), "url"))
        judged = urls.join(found.hint("merge"), "url").withColumn("own", F.when(F.col("diff") >= cut, ALLOW).otherwise(BLOCK))
    else:
        judged = urls.withColumn("diff", F.lit(0.0)).withColumn("own", F.lit(ALLOW))
    judged = judged.select("url", "host", "path", "rule", F.coalesce("verdict", "own").alias("verdict"), "diff")
    return rows.join(judged.hint("merge"), "url").drop("url")
