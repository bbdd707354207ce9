"""Scans of the raw collections, each with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaloom import schemas
from qaloom.functions.text import strip_ws, text_or
from qaloom.operators.numbering import global_index, stacked_index
from qaloom.session import broadcast_if_small, stage
from qaloom.sources.ranges import CsvCutter, JsonCutter, read_records

Paths = str | Sequence[str]

# Columns that together give the order of the lines of a text scan.
ORDER_COLUMNS = ("_file", "_block", "_line")


def line_order() -> list[Column]:
    """Order key of a scan: file, split start inside the file, and reading order inside the split."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ]


def read_jsonl(spark: SparkSession, path: Paths, schema: str, ordered: bool = False) -> DataFrame:
    """One object per line; absent fields are NULL. ``ordered`` adds the line-order columns."""
    lines = spark.read.schema(schema).json(path)
    return lines.select(*lines.columns, *line_order()) if ordered else lines


def _numbered(landed: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``position``, counted from 0 over all files in path order, to landed elements of records.

    Records are staged as texts, which take less room than their columns, and parsed by whatever reads them.
    """
    placed = {"_stretch": F.struct("_file", "_range", "_part"), "_nth": F.col("_at") + F.col("_pos")}
    counted = None if counted is None else counted.withColumns(placed)
    numbered = stacked_index(landed.withColumns(placed), "_stretch", "_nth", "position", counted)
    return numbered.drop("_stretch", "_nth", "_range", "_part", "_at", "_pos")


def read_question_bundle(
    spark: SparkSession, path: Paths, schema: str = schemas.YES_NO_QUESTION, root: str = "questions"
) -> DataFrame:
    """Root objects ``{"questions": […]}``: one row per question with its ``position`` in the input.

    A file of any size is read by many tasks (:mod:`qaloom.sources.ranges`). Elements that are null are rows of NULLs;
    other fields of the root are passed over.
    """
    records = read_records(spark, path, JsonCutter(root))
    elements = F.concat(F.lit("["), F.regexp_replace("text", r"^[\s,]+", ""), F.lit("]"))
    parsed = F.from_json(elements, f"ARRAY<STRUCT<{_struct_body(schema)}>>")
    exploded = records.where(F.trim(elements) != "[]").select("_file", "_range", "_part", "_at", F.posexplode(parsed).alias("_pos", "q"))
    return _numbered(exploded.select("_file", "_range", "_part", "_at", "_pos", "q.*")).drop("_file")


def read_keyed_json(spark: SparkSession, path: Paths, schema: str = schemas.KEYED_ARTICLE) -> DataFrame:
    """Root objects ``{id: {…}}``: one row per entry with ``key`` and ``position`` in file order.

    A file of any size is read by many tasks (:mod:`qaloom.sources.ranges`). A key that comes again in its file has its last
    value, at the place of its first one.
    """
    records = read_records(spark, path, JsonCutter(None))
    text = F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s,]+", ""), F.lit("}"))
    entries = F.map_entries(F.from_json(text, f"MAP<STRING, STRUCT<{_struct_body(schema)}>>"))
    exploded = records.select("_file", "_range", "_part", "_at", F.posexplode(entries).alias("_pos", "e"))
    landed = exploded.select("_file", "_range", "_part", "_at", "_pos", F.col("e.key").alias("key"), "e.value.*")
    keys = stage(landed.select("_file", "_range", "_part", "_at", "_pos", "key"), "keys")
    placed = _numbered(landed, keys)
    twice = keys.groupBy("_file", "key").agg(F.count("*").alias("_n")).where("_n > 1")
    if twice.isEmpty():
        return placed.drop("_file")
    again = _numbered(keys).groupBy("_file", "key").agg(F.min("position").alias("_first"), F.max("position").alias("_last"), F.count("*").alias("_n"))
    again = stage(again.where("_n > 1").drop("_n"), "repeated-keys")
    fields = [c for c in placed.columns if c not in ("_file", "key", "position")]
    known = placed.join(broadcast_if_small(again.select("_file", "key", "_first", "_last")), ["_file", "key"], "left")
    # A repeated key is the row of its last value, moved to the place of its first.
    kept = known.where("_last IS NULL OR _last = position").withColumn("_place", F.coalesce("_first", "position"))
    return global_index(kept.select("key", *fields, "_place"), ["_place"], "position").drop("_place")


def _struct_body(schema: str) -> str:
    """``a STRING, b INT`` as the inside of ``STRUCT<…>``."""
    depth, parts, current = 0, [], ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    parts.append(current)
    return ", ".join("`{}`: {}".format(*part.strip().split(" ", 1)) for part in parts)


def read_qa_csv(
    spark: SparkSession,
    path: Paths,
    schema: str = schemas.QA_PAIR,
    na_values: Iterable[str] = (),
    multiline: bool = True,
) -> DataFrame:
    """CSV with a header; quoted commas, quotes and line breaks survive, and a file of any size is read by many tasks.

    Only an empty field is NULL unless ``na_values`` names more. The header has to name the columns of the schema.
    ``multiline=False`` saves the pass that places the record borders where no field holds a line break.
    """
    table = _multiline_csv(spark, path, schema) if multiline else (
        spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).schema(schema).csv(path)
    )
    missing = list(na_values)
    if not missing:
        return table
    texts = {f.name for f in table.schema.fields if f.dataType.typeName() == "string"}
    return table.select(
        *[F.when(~F.col(c).isin(missing), F.col(c)).alias(c) if c in texts else F.col(c) for c in table.columns]
    )


def _multiline_csv(spark: SparkSession, path: Paths, schema: str) -> DataFrame:
    """Records placed by their quotes (:mod:`qaloom.sources.ranges`), then parsed one by one."""
    records = read_records(spark, path, CsvCutter()).withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
    fields = StructType.fromDDL(schema).fields
    # Columns that folders name are not in the files.
    folders = set(spark.read.text(path).columns) - {"value"}
    names = [f.name for f in fields if f.name not in folders]
    options = {"escape": '"', "multiLine": "true"}
    # The first record of a file, which may be the only one of its range that began there, is the header.
    first = F.min(F.struct("_range", "_part", "_at")).over(Window.partitionBy("_file"))
    heads = records.where("_at = 0").withColumn("_first", first).where(F.struct("_range", "_part", "_at") == F.col("_first"))
    heads = stage(heads.select("_file", "_range", "_part", "_at", "text"), "headers")
    named = F.from_csv("text", ", ".join(f"_{i} STRING" for i in range(len(names) + 1)), options)
    wrong = heads.select(F.array(*[named[f"_{i}"] for i in range(len(names) + 1)]).alias("found")).where(
        F.transform("found", lambda x: F.lower(F.trim(x))) != F.array(*[F.lit(n.lower()) for n in names], F.lit(None))
    ).first()
    if wrong:
        raise ValueError(f"the header names {[x for x in wrong['found'] if x is not None]}, the schema {names}")
    rows = records.join(broadcast_if_small(heads.drop("text")), ["_file", "_range", "_part", "_at"], "left_anti")
    inside = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name not in folders)
    of_folder = lambda f: F.url_decode(F.regexp_extract("_file", f"/{f.name}=([^/]*)/", 1)).cast(f.dataType)
    parsed = rows.select("_file", F.from_csv("text", inside, options).alias("r"))
    return parsed.select(*[of_folder(f).alias(f.name) if f.name in folders else F.col(f"r.`{f.name}`") for f in fields])


def read_id_text_tsv(spark: SparkSession, path: Paths, schema: str = schemas.ID_TEXT) -> DataFrame:
    """Tab-separated lines without a header; splittable, since a field holds no line break."""
    return spark.read.option("sep", "\t").option("header", False).option("escape", '"').schema(schema).csv(path)


def read_qrels(spark: SparkSession, path: Paths, ordered: bool = False) -> DataFrame:
    """Blank-separated judgments ``query_id iteration doc_id relevance``, without the iteration."""
    lines = spark.read.option("sep", " ").option("header", False).schema(schemas.QRELS).csv(path)
    extra = line_order() if ordered else []
    return lines.select("query_id", "doc_id", "relevance", *extra)


def read_id_list(spark: SparkSession, path: Paths, name: str = "doc_id") -> DataFrame:
    """One id per line, stripped, as a set."""
    return spark.read.text(path).select(strip_ws("value").alias(name)).distinct()


def read_topics_xml(spark: SparkSession, path: Paths, row_tag: str = "topic") -> DataFrame:
    """Topics with their ``number`` attribute; absent child elements are empty texts."""
    topics = spark.read.format("xml").option("rowTag", row_tag).option("ignoreSurroundingSpaces", False).schema(schemas.TOPIC).load(path)
    return topics.select(
        F.col("_number").alias("query_id"), *[text_or(c).alias(c) for c in ("query", "question", "narrative")]
    )


def experiment_config(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Experiment settings as a relation: one row per task and dataset, absent settings NULL."""
    names = [part.strip().split(" ")[0] for part in schemas.EXPERIMENT.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schemas.EXPERIMENT)
