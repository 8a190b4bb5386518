"""Corpus sources, inventory, routing, stores and validation."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.session import scratch_dir


# ---------------------------------------------------------------- reading
def read_tree(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(path, text, size_bytes)`` of every file under ``root``; undecodable bytes are replaced.

    Files above ``max_bytes`` are left out by their listed length, before their content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    # listed paths are absolute: the root's first occurrence is its prefix, later ones are folders below it
    top = F.lit(root.rstrip("/"))
    rel = F.regexp_replace(F.substring(F.col("path"), F.instr("path", top) + F.length(top), F.length("path")), "^/+", "")
    # a plain cast keeps every byte; the replacement of bad sequences happens when text is read
    return raw.select(rel.alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("size_bytes"))


def inventory(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Path, kind, language, size, hash and component hint of every file a scan keeps."""
    size = F.octet_length("text")
    keep = files.withColumn("size_bytes", size.cast("bigint")).filter(~tx.skip_file(F.col("path"), max_bytes, F.col("size_bytes")))
    p = F.col("path")
    return keep.select(
        "path", tx.artifact_type(p).alias("kind"), tx.language(p).alias("language"), "size_bytes",
        F.sha2("text", 256).alias("sha"), F.split_part(p, F.lit("/"), F.lit(1)).alias("component_hint"),
    )


def sniff(text: Column, markers: list[str], head: int | None = None) -> Column:
    """True when any marker is in the text, or in its head when ``head`` is given."""
    c = F.substring(text, 1, head) if head else text
    return reduce(lambda a, b: a | b, [c.contains(m) for m in markers])


def route_files(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(path, extractor)`` pairs: each path against the fixed pattern list, once per extractor.

    The rules become one array expression per row, so routing needs no join and no shuffle.
    """
    by_name: dict[str, list[str]] = {}
    for name, pattern in rules:
        by_name.setdefault(name, []).append(pattern)
    hits = [
        F.when(reduce(lambda a, b: a | b, [F.col("path").rlike(p) for p in patterns]), F.lit(name))
        for name, patterns in by_name.items()
    ]
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("extractor"))


def module_roots(roots: DataFrame) -> DataFrame:
    """One row per module root with its name, family and number of descriptors."""
    per = roots.groupBy("root").agg(F.count(F.lit(1)).alias("descriptors"))
    return per.select("root", F.substring_index("root", "/", -1).alias("module"), tx.family_from_path(F.col("root")).alias("family"), "descriptors")


# ---------------------------------------------------------------- lines and sections
def line_hits(files: DataFrame, key: str, pattern: str) -> DataFrame:
    """``(key, line_no, hit)`` for every regex hit, with its 1-based line."""
    lines = files.filter(F.col("text").rlike(pattern)).select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(
        key, (F.col("pos") + 1).cast("bigint").alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("hit")
    )


def section_words(files: DataFrame, key: str, min_words: int) -> DataFrame:
    """Words per ``##`` section, numbered from 1; a text stays one row until its sections are cut."""
    body = F.concat(F.lit("\n"), F.col("text"))
    parts = F.slice(F.split(body, "\n## "), 2, 1 << 30)
    cut = files.select(key, F.posexplode(parts).alias("pos", "part"))
    heading_end = F.instr("part", "\n")
    prose = F.when(heading_end > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise("")
    words = tx.word_count(prose).cast("bigint")
    return cut.select(key, (F.col("pos") + 1).cast("bigint").alias("section"), words.alias("words"), (words < min_words).alias("below_min"))


# ---------------------------------------------------------------- stores
class ChunkStore:
    """Append-only JSON-lines store; unreadable lines are skipped on load."""

    SCHEMA = "id string, component string, text string, path string, start_line bigint, end_line bigint, vector array<float>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{scratch_dir(spark)}/chunks-{uuid.uuid4().hex}"

    def append(self, chunks: DataFrame) -> None:
        chunks.write.mode("append").json(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("mode", "DROPMALFORMED").json(self.path)


def write_records(records: DataFrame, path: str, fmt: str = "parquet", by: str | None = "component") -> None:
    """Record, graph or coverage sink: parquet / json / csv, partitioned when ``by`` is given."""
    writer = records.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def unseen(files: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("extractor", "version", "sha")) -> DataFrame:
    """Files whose (extractor, version, hash) is not in the fact table yet."""
    return files.join(done.select(*keys).distinct(), list(keys), "left_anti")


# ---------------------------------------------------------------- validation and inputs
def validate(rows: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Violations ``(key, field, problem)``: all constraints are checked in one pass."""
    checks = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit("missing").alias("problem"))) for f in required]
    for f, values in (allowed or {}).items():
        checks.append(F.when(~F.col(f).isin(*values), F.struct(F.lit(f).alias("field"), F.lit("not allowed").alias("problem"))))
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(key, "v.field", "v.problem")


def normalize_relationship(rows: DataFrame, col: str) -> DataFrame:
    """A relationship given as a bare string or as a struct, in one shape."""
    get = lambda path: F.try_variant_get(col, path, "string")
    kind = F.schema_of_variant(col)
    bare = F.when(kind == "STRING", get("$"))
    return (
        rows.withColumn("rel_type", F.when(kind == "STRING", F.lit("related_to")).otherwise(get("$.type")))
        .withColumn(
            "display",
            F.coalesce(bare, get("$.target.display"), get("$.target.ref"), F.when(kind.startswith("OBJECT"), get("$.target"))),
        )
        .withColumn("source_name", F.coalesce(get("$.source.name"), get("$.source")))
        .withColumn("operation", F.coalesce(get("$.operation.type"), get("$.operation")))
    )


FINDING_SCHEMA = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>"
)


def scanner_findings(lines: DataFrame, prefix: str = "scan:") -> DataFrame:
    """Findings rows from the JSON an external code scanner wrote (column ``value``)."""
    r = lines.select(F.explode(F.from_json("value", FINDING_SCHEMA)["results"]).alias("r"))
    line = F.coalesce("r.start.line", F.lit(1)).cast("string")
    return r.select(
        F.concat(F.lit(prefix), "r.check_id").alias("rule_id"),
        F.lower(F.coalesce("r.extra.severity", F.lit("info"))).alias("severity"),
        F.coalesce("r.extra.message", F.lit("")).alias("message"),
        F.col("r.path").alias("file"),
        F.concat_ws(":", "r.path", line).alias("anchor"),
    )


def document_titles(files: DataFrame) -> DataFrame:
    """Kind and title of a document from its path: readme, decision record, or the file's stem."""
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    adr = F.lower("path").rlike("(^|/)adr[s]?/")
    kind = F.when(F.lower(stem) == "readme", "readme").when(adr, "decision").otherwise("document")
    title = F.when(kind == "readme", F.lit("README")).when(adr, F.concat(F.lit("ADR "), stem)).otherwise(stem)
    return files.select("path", kind.alias("kind"), title.alias("title"))
