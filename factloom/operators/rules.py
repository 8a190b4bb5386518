"""Quality rules, hypotheses and evidence gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A finding is raised where ``predicate`` holds; it may be a user-supplied Column."""

    rule_id: str
    severity: str
    predicate: Column
    message: Column


def missing_logging() -> Rule:
    """A record with steps and no logging."""
    return Rule(
        "missing_logging", "medium", (F.col("steps") > 0) & (F.coalesce("logging", F.lit(0)) == 0),
        F.concat(F.coalesce("name", F.lit("signal")), F.lit(" has "), F.col("steps").cast("string"), F.lit(" steps but no logging metadata.")),
    )


def insecure_http(url: str = "url") -> Rule:
    """A resource whose URL is plain http."""
    return Rule("insecure_http", "high", F.lower(F.trim(url)).startswith("http://"), F.concat(F.lit("Insecure HTTP endpoint detected: "), F.col(url)))


def run_rules(rows: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Findings of all rules in one pass: each rule is a nullable struct, the non-null ones explode."""
    hits = [
        F.when(r.predicate, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), r.message.alias("message")))
        for r in rules
    ]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(*keep, "f.*")


# Hypotheses with their scores.
HYPOTHESES = (
    ("orchestrates", "Likely orchestrates multiple subprocesses to complete a transaction.", 0.45, "processes >= 2"),
    ("common_data", "Shares datastore usage with adjacent processes, suggesting a common data model.", 0.35, "shared_data > 0"),
    ("shared_context", "Probably exchanges identifiers with peer flows to keep customer context aligned.", 0.3, "shared_ids > 0"),
    ("search_entry", "Acts as the entry point of a Search → Get → Sort experience for the same domain.", 0.33, "contains(lower(name), 'search') AND search_peers > 0"),
    ("boundary", "Serves as an integration boundary that receives requests and publishes events/messages.", 0.32, "interfaces > 0 AND services > 0"),
)
FALLBACK = ("records", "Maintains authoritative records even when source XML omits business commentary.", 0.25, "datastores > 0")


def hypotheses(records: DataFrame, key: str, cap: int = 5) -> DataFrame:
    """Up to five hypotheses per record, in rule order; the fallback only when no other holds."""
    as_struct = lambda h: F.struct(F.lit(h[0]).alias("rule"), F.lit(h[1]).alias("hypothesis"), F.lit(h[2]).alias("score"))
    main = F.array_compact(F.array(*[F.when(F.expr(h[3]), as_struct(h)) for h in HYPOTHESES]))
    last = F.array_compact(F.array(F.when(F.expr(FALLBACK[3]), as_struct(FALLBACK))))
    rows = records.withColumn("m", main).withColumn("l", last)
    return rows.select(key, F.explode(F.slice(F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("l")), 1, cap)).alias("h")).select(key, "h.*")


def enough_evidence() -> Column:
    """A record is documented only with inputs or outputs, calls, and errors or logging."""
    return (
        (F.col("identifiers") > 0)
        & ((F.col("invocations") > 0) | (F.col("datastores") + F.col("processes") + F.col("services") > 0))
        & ((F.col("errors") > 0) | (F.col("logging") > 0))
    )


def coverage_shares(records: DataFrame, minimum: float = 0.04) -> DataFrame:
    """Share of records with calls, logging and errors, and whether each reaches the minimum."""
    share = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    r = records.agg(*[F.round(share(c), 4).alias(c + "_share") for c in ("calls", "logging", "errors")])
    return r.select("*", *[(F.col(c + "_share") >= minimum).alias(c + "_ok") for c in ("calls", "logging", "errors")])
