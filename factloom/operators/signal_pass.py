"""All facts of a signal in one pass: every input is scanned once and meets the others in one exchange.

Steps, relations, triggers, control edges and the signals themselves become rows with lists of tagged facts
``(field, key, sub)``.  Rows meet by signal and are split into facts there, so that repeated facts, first facts and
dependencies need no exchange of their own; a signal with a third of all steps is split before and spread over
its facts.  The result is written: counts, scores, worklists and hypotheses read it instead of their inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as tx
from factloom.operators import ordered, steps as st
from factloom.operators.hot import SLOT, hot_keys
from factloom.session import Rounds

#: Fields whose number is a count of rows; all others count distinct keys.
COUNTED = ("steps", "relationships", "triggers")
#: Fields of which the first facts count; only these carry their place.
ORDERED = ("invocations", "default_errors")
#: Most facts that count for a field.
CAPS = {"identifiers": st.IDENTIFIER_CAP, "interfaces": st.INTERFACE_CAP, "logging": st.ERROR_CAP, "errors": st.ERROR_CAP}
#: Error defaults of signals without an explicit error.
DEFAULT_ERRORS = 3
#: Rows of steps and relations that one task splits into facts.
TASK_ROWS = 200_000
_BUCKETS = ("datastores", "processes", "services")
#: What is known of a signal itself.
INFO = ("kind", "component", "name", "family", "module")
_NO_INFO = "struct<" + ", ".join(f"{c}: string" for c in INFO) + ">"


def _text(*parts: Column | str) -> Column:
    return F.array(*[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def _fact(field: str, when: Column, key: Column, sub: int = 0) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), key.alias("key"), F.lit(sub).alias("sub")))


def _each(field: str, items: Column) -> Column:
    """A fact per non-empty item."""
    found = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.transform(found, lambda x: F.struct(F.lit(field).alias("field"), F.array(x).alias("key"), F.lit(0).alias("sub")))


def _deps(bucket: Column | str, values: list[Column]) -> Column:
    bucket = F.lit(bucket) if isinstance(bucket, str) else bucket
    found = F.filter(F.array(*values), lambda x: x.isNotNull() & (x != "") & bucket.isNotNull())
    return F.transform(found, lambda x: F.struct(F.lit("dependency").alias("field"), F.array(bucket, x).alias("key"), F.lit(0).alias("sub")))


def _gathered(df: DataFrame, src: int, single: list[Column], lists: list[Column], order: list[Column] | None = None, info: Column | None = None) -> DataFrame:
    """An input row with the list of its facts."""
    at = order or [F.lit(None).cast("int"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")]
    facts = F.concat(F.array_compact(F.array(*single)), *lists)
    place = [c.cast(k).alias(n) for c, n, k in zip(at, st.ORDER, ("int", "bigint", "bigint"))]
    return df.select("signal_id", F.lit(src).alias("src"), *place, facts.alias("facts"), (F.lit(None).cast(_NO_INFO) if info is None else info).alias("info"))


def _exploded(rows: DataFrame) -> DataFrame:
    """A row per fact; those of ``ORDERED`` carry their place, which also tells default errors apart."""
    rows = rows.select("signal_id", "src", *st.ORDER, F.explode("facts").alias("f"), "info")
    place = F.when(F.col("f.field").isin(*ORDERED), F.struct("src", *st.ORDER, F.col("f.sub").alias("sub")))
    # every row, as the first ones are taken before repeated ones are
    key = F.when(F.col("f.field") == "default_errors", F.concat("f.key", _text(*st.ORDER))).otherwise(F.col("f.key"))
    return rows.select("signal_id", "f.field", key.alias("key"), place.alias("at"), F.when(F.col("f.field") == "signal", F.col("info")).alias("info"))


def _of_steps(steps: DataFrame) -> DataFrame:
    role = lambda r: tx.has_role(r, F.col("connector"))
    low, none = F.lower(F.coalesce("connector", F.lit(""))), F.lit(None).cast("string")
    order = [F.col(c) for c in st.ORDER]
    default = (
        F.when(low.isin("http", "rest", "soap"), "http_error_handling").when(low.isin("jdbc", "sql", "db"), "db_error_handling")
        .when(low.isin("jms", "queue", "topic"), "messaging_error_handling")
    )
    named = lambda word: F.coalesce(F.lower("name").contains(word), F.lit(False))
    single = [
        _fact("steps", F.lit(True), _text()),
        _fact("interfaces", role("interface.receive") | role("interface.reply"), _text(F.col("connector"), F.col("url"), F.col("method"))),
        _fact("invocations", role("invoke.process"), _text(F.lit("Process"), F.coalesce("called_process", "name"), none), 0),
        _fact("invocations", role("data.jdbc"), _text(F.lit("JDBC"), F.col("datasource"), F.col("sql_text")), 1),
        _fact("invocations", role("messaging.jms"), _text(F.lit("JMS"), F.col("destination"), none), 2),
        _fact("logging", role("ops.log") | named("log"), _text(F.col("name"))),
        _fact("errors", role("error.throw") | named("error"), _text(F.col("name"), none)),
        _fact("default_errors", default.isNotNull(), _text(F.col("name"), default)),
    ]
    data = (low.contains("jdbc") | low.contains("sql")) & F.col("sql_text").isNotNull()
    mapper = (low.contains("mapper") | (low == "map")) & F.col("inputs_keys").isNotNull()
    words = F.when(mapper, tx.identifier_tokens(F.array_join(F.split("inputs_keys", ","), " "))).otherwise(F.array().cast("array<string>"))
    lists = [_deps(F.when(data, F.lit("datastores")), [F.col("datasource"), tx.sql_table_by_order(F.col("sql_text"))]), _each("identifiers", words)]
    return _gathered(steps, 1, single, lists, order)


def _of_relations(relations: DataFrame) -> DataFrame:
    kind, target = F.lower(F.coalesce("target_kind", "rel_type", F.lit(""))), F.col("target_ref")
    hint = F.lower(F.coalesce("target_kind", F.lit("")))
    data = st._contains_any(kind, ("sql", "jdbc", "db", "database"))
    lists = [
        _deps(F.when(data | st._contains_any(hint, st.vocab.DATASTORE_KIND_HINTS), F.lit("datastores")), [target]),
        _deps(F.when(st._contains_any(hint, st.vocab.SERVICE_KIND_HINTS), F.lit("services")), [target]),
        _deps(F.when(F.col("rel_type").isin("calls", "invokes"), F.lit("processes")), [target]),
    ]
    return _gathered(relations, 2, [_fact("relationships", F.lit(True), _text())], lists)


def _of_triggers(triggers: DataFrame) -> DataFrame:
    single = [
        _fact("triggers", F.lit(True), _text()),
        _fact("interfaces", F.lit(True), _text(F.coalesce("type", F.lit("trigger")), F.col("path"), F.col("method"))),
    ]
    return _gathered(triggers, 0, single, [_each("identifiers", tx.identifier_tokens(F.concat_ws(" ", "path", "name", "type")))])


def facts(signals: DataFrame, steps: DataFrame, relations: DataFrame, triggers: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(signal_id, field, key, n, info, rank, dep)``, written: each distinct fact with its number of rows.

    Of ``ORDERED`` fields only the first facts stay, with their ``rank``; ``dep`` is the (bucket, value) of a
    dependency, on one fact only.  ``signals`` (``INFO``, signal_id, path) hold a signal once;
    ``transitions(signal_id, src, dst, condition)``.

    Rows meet by signal before they are split into facts, and all that follows stays in that partition.  Hot
    signals (``hot.hot_keys``) are split first and spread over their facts.
    """
    rows = _gathered(signals, 0, [_fact("signal", F.lit(True), _text())], [_each("identifiers", tx.identifier_tokens(F.col("path")))], info=F.struct(*INFO))
    edges = _gathered(transitions, 1, [_fact("errors", F.lit(True), _text(F.col("src"), F.col("condition")))], [])
    for more in (_of_steps(steps), _of_relations(relations), _of_triggers(triggers), edges):
        rows = rows.unionByName(more)
    rounds = Rounds(signals.sparkSession, depth=2)
    sizes = steps.select("signal_id").unionByName(relations.select("signal_id")).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("n"), F.sum("n").alias("total")).first()
    hot = hot_keys(sizes, "signal_id", most["total"]) if (most["n"] or 0) > SLOT else None
    # a task holds about TASK_ROWS rows of steps and relations, so that its sorts stay in memory
    tasks = max(signals.sparkSession.sparkContext.defaultParallelism, (most["total"] or 0) // TASK_ROWS + 1)
    if hot is None:
        return rounds.keep(_marked(_ranked(_summed(_exploded(rows.repartition(tasks, "signal_id"))))))
    few = F.broadcast(hot.select("signal_id"))
    made = _marked(_ranked(_summed(_exploded(rows.join(few, "signal_id", "left_anti").repartition(tasks, "signal_id")))))
    spread = rounds.keep(_summed(_exploded(rows.join(few, "signal_id", "left_semi"))), "hot")
    ordered_ones = F.col("field").isin(*ORDERED)
    # ranks above the caps are pruned in every task
    firsts = _ranked(ordered.top_per_key(spread.filter(ordered_ones), ["signal_id", "field"], [F.col("at")], max(st.INVOCATION_CAP, DEFAULT_ERRORS)))
    plain = firsts.unionByName(spread.filter(~ordered_ones).drop("at").withColumn("rank", F.lit(None).cast("int")))
    deps = plain.select("signal_id", _dependency().alias("dep")).filter("dep IS NOT NULL").distinct()
    none = F.lit(None)
    deps = deps.select("signal_id", F.lit("marked").alias("field"), none.cast("array<string>").alias("key"), none.cast("bigint").alias("n"), none.cast(_NO_INFO).alias("info"), none.cast("int").alias("rank"), "dep")
    made = made.unionByName(plain.withColumn("dep", none.cast(made.schema["dep"].dataType))).unionByName(deps)
    return rounds.keep(made)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signal_id", "field", "key").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), F.max("info").alias("info"))


def _ranked(made: DataFrame) -> DataFrame:
    """Facts with the ``rank`` of ``ORDERED`` ones; those past the cap are dropped, of equal default errors all but the first."""
    by = Window.partitionBy("signal_id", "field").orderBy("at")
    error, one = F.col("field") == "default_errors", F.slice("key", 1, 2)
    rows = made.withColumns({"rank": F.row_number().over(by), "b1": F.lag(one, 1).over(by), "b2": F.lag(one, 2).over(by)})
    again = ((F.col("rank") > 1) & one.eqNullSafe(F.col("b1"))) | ((F.col("rank") > 2) & one.eqNullSafe(F.col("b2")))
    first = F.when(error, (F.col("rank") <= DEFAULT_ERRORS) & ~again).when(F.col("field") == "invocations", F.col("rank") <= st.INVOCATION_CAP)
    rank = F.when(F.col("field").isin(*ORDERED), F.col("rank"))
    return rows.filter(F.coalesce(first, F.lit(True))).select("signal_id", "field", "key", "n", "info", rank.alias("rank"))


def _dependency() -> Column:
    """``(bucket, value)`` of a fact that is a dependency."""
    kind, value = F.col("key")[0], F.col("key")[1]
    bucket = F.when(kind == "Process", "processes").when(kind == "JMS", "services").otherwise("datastores")
    called = (F.col("field") == "invocations") & value.isNotNull() & (value != "")
    return F.when(F.col("field") == "dependency", F.struct(kind.alias("bucket"), value.alias("value"))).when(called, F.struct(bucket.alias("bucket"), value.alias("value")))


def _marked(rows: DataFrame) -> DataFrame:
    """Facts with ``dep``, each distinct one on one fact of its signal."""
    rows = rows.withColumn("dep", _dependency())
    no = F.row_number().over(Window.partitionBy("signal_id", "dep").orderBy("field", "rank"))
    return rows.withColumn("no", no).withColumn("dep", F.when(F.col("no") == 1, F.col("dep"))).drop("no")


def dependencies(found: DataFrame) -> DataFrame:
    """Distinct ``(signal_id, bucket, value)`` of datastores, processes and services, from ``facts``."""
    return found.filter("dep IS NOT NULL").select("signal_id", "dep.bucket", "dep.value")


def shared_stores(found: DataFrame) -> DataFrame:
    """``(signal_id, shared_data)``: how many datastores of a signal another one has too."""
    held = dependencies(found).filter("bucket = 'datastores'").select("signal_id", "value")
    known = held.groupBy("value").agg(F.count(F.lit(1)).alias("users")).filter("users > 1")
    return held.join(known, "value").groupBy("signal_id").agg(F.count(F.lit(1)).alias("shared_data"))


def identifiers(found: DataFrame) -> DataFrame:
    """The first identifiers of a signal in name order, from ``facts``."""
    rows = found.filter("field = 'identifiers'").select("signal_id", F.col("key")[0].alias("identifier"))
    return ordered.top_per_key(rows, ["signal_id"], [F.col("identifier")], st.IDENTIFIER_CAP)


def presence(found: DataFrame) -> DataFrame:
    """A row per signal: ``INFO``, how many facts of each field it has, and ``calls``."""
    fields = [*COUNTED, *CAPS, *ORDERED]
    rows = {f: F.sum(F.when(F.col("field") == f, F.col("n") if f in COUNTED else F.lit(1).cast("bigint"))) for f in fields}
    rows |= {f: F.sum(F.when(F.col("dep.bucket") == f, F.lit(1).cast("bigint"))) for f in _BUCKETS}
    count = [F.coalesce(c, F.lit(0)).alias(f) for f, c in rows.items()]
    out = found.groupBy("signal_id").agg(F.max("info").alias("info"), *count).filter("info IS NOT NULL").select("signal_id", "info.*", *rows)
    out = out.withColumns({f: F.least(F.col(f), F.lit(cap).cast("bigint")) for f, cap in CAPS.items()})
    errors = F.when(F.col("errors") > 0, F.col("errors")).otherwise(F.col("default_errors"))
    return out.withColumns({"errors": errors, "calls": F.col("services") + F.col("processes")}).drop("default_errors")
