"""Corpus and question records: normalisation, identity, answers, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodestrand.functions import text as T

TEXT_KEYS = ["text", "content", "context", "page_content", "body", "passage"]
ID_KEYS = ["id", "doc_id", "document_id", "source", "title", "url"]
RECORD_SCHEMA = (
    "text string, content string, context string, page_content string, body string, passage string, title string, "
    "source string, url string, doc_id string, metadata map<string,string>"
)
#: Rows are numbered within ranges of so many keys, and by the ranges' sums.
NUMBER_SPAN = 65_536


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether the JSON at ``path`` begins with a list, by the first bytes of its first file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath() for f in fs.listStatus(at) if f.getLen() and not f.getPath().getName().startswith(("_", "."))]
    if not files:
        return False
    stream = fs.open(files[0])
    try:
        return bytes(stream.readNBytes(256)).decode("utf-8", "replace").lstrip("\ufeff \t\r\n").startswith("[")
    finally:
        stream.close()


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON arrays, each of which is read by one task, or of JSON lines, which are read in parts, under an
    explicit schema. A missing path is an error."""
    return spark.read.schema(schema).option("multiLine", _is_array(spark, path)).json(path)


def _as_text(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType
    return F.concat_ws(" ", name) if isinstance(kind, S.ArrayType) else F.col(name).cast("string")


def text_of(rows: DataFrame) -> Column:
    """The first non-empty of the text columns; lists of texts are joined by blanks."""
    return T.first_truthy(*[_as_text(rows, c) for c in TEXT_KEYS if c in rows.columns], F.lit(None).cast("string"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``no``, their place from 0 in ascending order of the unique whole number ``key``. A task numbers a
    range of NUMBER_SPAN keys; only one count for each range comes together."""
    slot = F.expr(f"{key} div {NUMBER_SPAN}")
    sizes = rows.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_slot").orderBy(key)
    within = rows.withColumn("_slot", slot).withColumn("no", F.row_number().over(own) - 1)
    return within.join(starts, "_slot").withColumn("no", F.col("no") + F.col("_start")).drop("_slot", "_start")


def normalize(records: DataFrame, position: str) -> DataFrame:
    """One row per record with text: ``pos``, ``content`` without outer white space, ``doc_id``, title, source, url,
    ``metadata``, the source ``label`` and the ``origin`` that tells equal contents apart.

    The text is the first non-empty text column, else the columns that are neither text nor identity, joined. Records
    without any are dropped, and a missing ``doc_id`` is made of the place among the kept ones. ``metadata`` has the
    record's own map, over it every other column that isn't null, and the position as ``index``.
    """
    have = set(records.columns)
    others = [c for c in records.columns if c not in {*TEXT_KEYS, "metadata", position}]
    spare = F.concat_ws(" ", *[_as_text(records, c) for c in others if c not in ID_KEYS])
    text = F.coalesce(text_of(records), F.lit(""))
    content = T.strip(F.when(T.strip(text) != "", text).otherwise(spare))
    fields = [F.struct(F.lit(c).alias("key"), _as_text(records, c).alias("value")) for c in others]
    fields.append(F.struct(F.lit("index").alias("key"), F.col(position).cast("string").alias("value")))
    own = F.map_from_entries(F.filter(F.array(*fields), lambda x: x["value"].isNotNull()))
    nested = F.coalesce(F.col("metadata") if "metadata" in have else F.lit(None), F.create_map().cast("map<string,string>"))
    ids = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("doc_id", "title", "source", "url")]
    rows = records.select(F.col(position).cast("long").alias("pos"), content.alias("content"), *ids, own.alias("own"), nested.alias("nested"))
    rows = rows.where(F.length("content") > 0)
    unnamed = numbered(rows.select("pos", F.col("doc_id").isNull().alias("unnamed")), "pos").where("unnamed").select("pos", "no")
    rows = rows.join(unnamed, "pos", "left").withColumn("doc_id", F.coalesce("doc_id", F.format_string("corpus-doc-%04d", "no")))
    named = F.map_concat(F.map_filter("own", lambda k, v: k != "doc_id"), F.create_map(F.lit("doc_id"), F.col("doc_id")))
    rows = rows.withColumn("own", named)
    metadata = F.map_concat(F.map_filter("nested", lambda k, v: ~F.map_contains_key("own", k)), F.col("own"))
    place = F.col("pos").cast("string")
    return rows.select(
        "pos", "content", "doc_id", "title", "source", "url",
        T.label(T.first_truthy(*[F.col(c) for c in ("title", "source", "url", "doc_id")], place)).alias("label"),
        T.first_truthy(F.col("source"), F.col("title"), F.col("url"), place).alias("origin"), metadata.alias("metadata"),
    )


def corpus(docs: DataFrame) -> DataFrame:
    """The normalised corpus of a table of arrivals: the latest arrival of each ``doc_pos``."""
    last = docs.where("doc_pos is not null").groupBy("doc_pos").agg(
        F.max_by(F.struct("doc_id", "title", "content", "source", "url", "metadata"), F.col("ingested_at")).alias("r")
    )
    return normalize(last.select("doc_pos", "r.*"), "doc_pos")


def limited(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in order: None is all, 0 is none."""
    if limit is None:
        return df
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise TypeError("limit must be an integer or None")
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.orderBy(order).limit(limit)


def reference_answers(given: Column) -> Column:
    """The different answers without outer white space, in order, blank ones left out."""
    trimmed = F.transform(F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda a: a.isNotNull()), T.strip)
    return F.array_distinct(F.filter(trimmed, lambda a: a != ""))


def _listed(value: Column, kind: S.DataType) -> Column:
    """A text, number or list of such as an array of texts; null as an empty one."""
    none = F.array().cast("array<string>")
    one = value.cast("array<string>") if isinstance(kind, S.ArrayType) else F.when(value.isNotNull(), F.array(value.cast("string")))
    return F.coalesce(one, none)


def given_answers(rows: DataFrame) -> Column:
    """All answers of question records in any of their shapes, in order: a scalar or list ``answer``, then ``answers``
    as a struct with ``text`` (scalar or list), as a list of texts, or as a list of structs with ``text`` or ``answer``,
    the first of them that isn't empty."""
    parts = []
    if "answer" in rows.columns:
        parts.append(_listed(F.col("answer"), rows.schema["answer"].dataType))
    if "answers" in rows.columns:
        kind, value = rows.schema["answers"].dataType, F.col("answers")
        if isinstance(kind, S.StructType):
            parts.append(_listed(value["text"], kind["text"].dataType))
        elif isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.StructType):
            inner = kind.elementType

            def of(x: Column) -> Column:
                lists = [_listed(x[n], inner[n].dataType) for n in ("text", "answer") if n in inner.names]
                filled = [F.when((F.size(y) > 0) & (F.coalesce(F.get(y, F.lit(0)), F.lit(" ")) != ""), y) for y in lists]
                return F.coalesce(*filled, F.array().cast("array<string>"))

            parts.append(F.coalesce(F.flatten(F.transform(F.filter(value, lambda x: x.isNotNull()), of)), F.array().cast("array<string>")))
        else:
            parts.append(_listed(value, kind))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def questions(rows: DataFrame) -> DataFrame:
    """(query_id, query, context, answers): a question once, by its first asking."""
    kept = [c for c in ("question", "context", "answer", "answers") if c in rows.columns]
    first = rows.where("question_id is not null").groupBy("question_id").agg(F.min_by(F.struct(*kept), F.col("asked_at")).alias("r")).select("question_id", "r.*")
    return first.select(F.col("question_id").alias("query_id"), T.strip(F.col("question")).alias("query"), "context", reference_answers(given_answers(first)).alias("answers"))


def validated(query: Column, most: int) -> Column:
    """``ok``, ``empty`` or ``too_long`` for a query without its outer white space."""
    q = T.strip(F.coalesce(query, F.lit("")))
    return F.when(q == "", "empty").when(F.length(q) > most, "too_long").otherwise("ok")


def joined(docs: DataFrame, keys: list[str], order: list[str], separator: str = "\n\n") -> DataFrame:
    """(keys..., text): the contents of each group in order, ``separator`` between; groups are ranked lists, bounded by
    their limit."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "content")))
    return docs.where(F.length(T.strip(F.col("content"))) > 0).groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["content"]), separator).alias("text"))


def provenance(docs: DataFrame) -> Column:
    """What a document's fingerprint is made of: its content and identity, and its metadata in order of their keys."""
    cols = [F.coalesce(F.col(c), F.lit("")) for c in ("content", "doc_id", "title", "source", "url") if c in docs.columns]
    if "metadata" in docs.columns:
        pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("\1"))))
        cols.append(F.array_join(F.array_sort(pairs), "\0"))
    return F.concat_ws("\0", *cols)


def fingerprint(docs: DataFrame, fan: int = 4096) -> DataFrame:
    """One hash of the ordered documents, their identity and metadata: the hashes of ``fan`` neighbours are hashed
    together, and so level by level, so no task ever holds more than ``fan`` hashes. An empty corpus has the hash of the
    empty text."""
    level = docs.select(F.col("pos").alias("at"), F.sha2(provenance(docs), 256).alias("h"))
    top = docs.agg(F.max("pos")).first()[0]
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        if top is None or top < fan:
            return level.agg(F.sha2(joined, 256).alias("fingerprint"))
        level = level.groupBy(F.expr(f"at div {fan}").alias("up")).agg(F.sha2(joined, 256).alias("h")).select(F.col("up").alias("at"), "h")
        top //= fan


EXPECTATIONS = "schema_version int, questions_sha256 string, expected_abstention_indexes array<double>"


def read_expectations(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """(query_id) of the questions that a benchmark expects to be abstained from, out of its JSON file. The file must
    be of version 1, name the digest of the very questions, and list positive whole numbers only."""
    rows = spark.read.schema(EXPECTATIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = rows.select("schema_version", "questions_sha256").first()
    if head is None or head["schema_version"] != 1:
        raise ValueError("unsupported version of expectations")
    if (head["questions_sha256"] or "").lower() != digest.lower():
        raise ValueError("the expectations belong to other questions")
    ids = rows.select(F.explode("expected_abstention_indexes").alias("x"))
    if not ids.where(F.col("x").isNull() | (F.col("x") <= 0) | (F.col("x") != F.floor("x"))).isEmpty():
        raise ValueError("expected abstentions must be positive whole numbers")
    return ids.select(F.col("x").cast("long").alias("query_id")).distinct()
