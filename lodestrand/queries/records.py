"""Queries over records: reading, identity, scans, chunks, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.operators import cache, chunking, dense
from lodestrand.queries import samples
from lodestrand.queries import sqlparts as P
from lodestrand.queries.registry import query
from lodestrand.session import file_state, shared_dir, spread, stage, table
from lodestrand.sources import documents as D
from lodestrand.sources import sinks


_corpora: dict[tuple, DataFrame] = {}


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The normalised corpus, written once for as long as its files are the same."""
    rows, path = table(spark, d, "corpus_docs"), f"{d}/corpus_docs.parquet"
    key = (spark.sparkContext.applicationId, path, file_state(spark, path))
    if key not in _corpora:
        _corpora[key] = stage(D.corpus(rows), "corpus")
    return _corpora[key]


def sample(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"WITH {P.CORPUS} SELECT pos, doc_id, title, source, url, length(content) AS chars FROM corpus")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("pos", "doc_id", "title", "source", "url", F.length("content").cast("long").alias("chars"))


@query(f"WITH {P.CORPUS} SELECT pos, content FROM corpus ORDER BY pos LIMIT 300")
def load_documents_limit(spark: SparkSession, d: str) -> DataFrame:
    return D.limited(corpus(spark, d).select("pos", "content"), "pos", 300)


@query(f"WITH {P.CORPUS} SELECT pos, label FROM corpus")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("pos", "label")


@query("SELECT coalesce(source, '?') AS source, count(*) AS n, count(*) FILTER (regexp_matches(content, '[^\\s\\x0b\\x{85}\\pZ]')) AS nonempty FROM corpus_docs GROUP BY 1")
def nonempty_docs(spark: SparkSession, d: str) -> DataFrame:
    full = F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False))
    return table(spark, d, "corpus_docs").groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"), F.count_if(full).alias("nonempty"))


@query(f"WITH {P.CORPUS} SELECT pos, sha256(content) AS digest FROM corpus")
def text_sha256(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("pos", F.sha2("content", 256).alias("digest"))


@query(f"WITH {P.CORPUS} SELECT doc_id AS path, printf('%s  %s', sha256(content), doc_id) AS line FROM corpus")
def release_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(corpus(spark, d).select(F.col("doc_id").alias("path"), "content"))


@query(
    f"WITH {P.CORPUS}, kept AS (SELECT doc_id, any_value(content) AS content FROM corpus GROUP BY doc_id HAVING count(*) = 1) SELECT doc_id AS path, CASE WHEN length(content) > 2000 THEN 'missing' WHEN length(content) > 1500 THEN 'changed' ELSE 'unexpected' END AS difference FROM kept WHERE length(content) > 1500 OR length(content) < 100"
)
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a manifest of them without the short ones, after the longest are gone and some long ones altered."""
    one = corpus(spark, d).groupBy("doc_id").agg(F.first("content").alias("content"), F.count("*").alias("n")).where("n = 1").select(F.col("doc_id").alias("path"), "content")
    size = F.length("content")
    now = one.where(size <= 2000).withColumn("content", F.when(size > 1500, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return sinks.verify(now, sinks.manifest(one.where(size >= 100)))


@query(f"WITH {P.CORPUS} SELECT pos, content, doc_id, title, source, url FROM corpus")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """The corpus' records written as JSON lines and read back under the schema of records."""
    path = f"{shared_dir(spark)}/stage/records-{uuid.uuid4().hex}"
    rows = corpus(spark, d).select(F.format_string("%d", "pos").alias("text"), F.col("content").alias("body"), F.struct("content").alias("ignored"), "doc_id", "title", "source", "url")
    rows.write.json(path)
    back = D.read_records(spark, path, D.RECORD_SCHEMA).select(F.col("text").cast("long").alias("pos"), "body", "doc_id", "title", "source", "url")
    return D.normalize(stage(back, "read-records"), "pos").select("pos", "content", "doc_id", "title", "source", "url")


@query(
    f"WITH {P.CORPUS}, {P.WITH_METADATA}, rows AS (SELECT pos, sha256(concat_ws(chr(0), content, doc_id, coalesce(title, ''), coalesce(source, ''), coalesce(url, ''), array_to_string(pairs, chr(0)))) AS h FROM described), "
    "up AS (SELECT pos // 4096 AS no, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM rows GROUP BY 1) "
    "SELECT CASE WHEN (SELECT max(pos) FROM rows) < 4096 THEN (SELECT sha256(string_agg(h, '' ORDER BY pos)) FROM rows) ELSE (SELECT sha256(string_agg(h, '' ORDER BY no)) FROM up) END AS fingerprint"
)
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return D.fingerprint(corpus(spark, d))


_SHAPES = f"""shapes AS (SELECT 'documents' AS shape, doc_id AS pos, coalesce(nullif({P.strip('text')}, ''), {P.strip('lang')}, '') AS content, lang AS extra FROM documents
 UNION ALL SELECT 'questions', question_id, {P.strip('context')}, NULL FROM (SELECT * FROM questions WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY asked_at) = 1)
 UNION ALL SELECT 'items', item_id, coalesce(nullif({P.strip('text')}, ''), {P.strip('split_name')}, ''), split_name FROM eval_items
 UNION ALL SELECT 'orders', o_orderkey, {P.strip("o_orderstatus || ' ' || o_orderpriority")}, NULL FROM orders)"""


@query(f"WITH {_SHAPES} SELECT shape, pos, length(content) AS chars, md5(content) AS digest, extra FROM shapes WHERE content <> ''")
def normalize_document_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Records of four shapes: under ``text`` (twice), under ``context``, and without a text column, whose other columns
    are joined."""
    first = table(spark, d, "questions").where("question_id is not null").groupBy("question_id").agg(F.min_by("context", "asked_at").alias("context"))
    shapes = {
        "documents": (table(spark, d, "documents").select("doc_id", "text", "lang").withColumnRenamed("doc_id", "no"), "no", "lang"),
        "questions": (first, "question_id", None),
        "items": (table(spark, d, "eval_items").select("item_id", "text", "split_name"), "item_id", "split_name"),
        "orders": (table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", None),
    }
    out = None
    for name, (rows, position, extra) in shapes.items():
        value = F.element_at("metadata", extra) if extra else F.lit(None).cast("string")
        one = D.normalize(rows, position).select(F.lit(name).alias("shape"), "pos", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"), value.alias("extra"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {P.CORPUS} SELECT coalesce(source, '?') AS source, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS digest FROM corpus WHERE pos IN (SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY coalesce(source, '?') ORDER BY pos) AS n FROM corpus) WHERE n <= 5) GROUP BY 1")
def join_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents of each source as one text."""
    from pyspark.sql import Window

    rows = corpus(spark, d).select(F.coalesce("source", F.lit("?")).alias("source"), "pos", "content")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).where("n <= 5")
    return D.joined(few, ["source"], ["pos"]).select("source", F.md5("text").alias("digest"))


@query(f"WITH {P.QUESTIONS} SELECT query_id, to_json({P.ANSWERS})::VARCHAR AS scalar, to_json({P.ANSWERS})::VARCHAR AS texts, to_json({P.ANSWERS})::VARCHAR AS pairs FROM asked")
def reference_answer_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The answers of every question in three other shapes, from which the same come out: the first as a scalar and all
    as a list, a list of texts, and a list of structs that have them by turns under ``text`` and ``answer``."""
    rows = table(spark, d, "questions").where("question_id is not null").groupBy("question_id").agg(F.min_by("answers", "asked_at").alias("a"))
    rows = stage(rows.select("question_id", F.coalesce(F.col("a.text"), F.array().cast("array<string>")).alias("g")), "given")
    turned = F.transform("g", lambda x, i: F.struct(F.when(i % 2 == 0, x).alias("text"), F.when(i % 2 == 1, x).alias("answer")))
    shapes = {
        "scalar": rows.select("question_id", F.get("g", F.lit(0)).alias("answer"), "g").withColumnRenamed("g", "answers"),
        "texts": rows.select("question_id", F.col("g").alias("answers")),
        "pairs": rows.select("question_id", turned.alias("answers")),
    }
    out = None
    for name, df in shapes.items():
        one = df.select(F.col("question_id").alias("query_id"), F.to_json(D.reference_answers(D.given_answers(df))).alias(name))
        out = one if out is None else out.join(one, "query_id")
    return out


@query(f"WITH {P.QUESTIONS} SELECT query_id FROM asked WHERE context IS NULL AND query_id > 0")
def expected_abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a context as a benchmark's expected abstentions: their file is written and read with its checks."""
    rows = D.questions(table(spark, d, "questions"))
    digest = D.fingerprint(rows.select(F.col("query_id").alias("pos"), F.col("query").alias("content"))).first()[0]
    ids = rows.where("context is null and query_id > 0").agg(F.array_sort(F.collect_list("query_id")).alias("expected_abstention_indexes"))
    path = f"{shared_dir(spark)}/stage/expectations-{uuid.uuid4().hex}"
    ids.select(F.lit(1).alias("schema_version"), F.lit(digest).alias("questions_sha256"), "expected_abstention_indexes").coalesce(1).write.json(path)
    return stage(D.read_expectations(spark, path, digest), "expectations")


@query(f"WITH {P.QUESTIONS} SELECT query_id, to_json({P.ANSWERS})::VARCHAR AS answers, coalesce({P.ANSWERS}[1], '') AS first_answer FROM asked")
def reference_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = D.questions(table(spark, d, "questions"))
    return rows.select("query_id", F.to_json("answers").alias("answers"), F.coalesce(F.get("answers", F.lit(0)), F.lit("")).alias("first_answer"))


@query(f"WITH {P.CORPUS}, {P.WITH_METADATA} SELECT pos, content, array_to_string(pairs, chr(10)) AS metadata FROM described")
def serialize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Content and metadata of every document, as they stand in its JSON record, read back from it."""
    record = F.from_json(F.to_json(F.struct("content", "metadata"), {"ignoreNullFields": "false"}), "content string, metadata map<string,string>")
    pairs = F.transform(F.map_entries("r.metadata"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("\1"))))
    return corpus(spark, d).select("pos", record.alias("r")).select("pos", "r.content", F.array_join(F.array_sort(pairs), "\n").alias("metadata"))


_SCANNED = f"(SELECT 's' || id AS key, text FROM {P.values(samples.TEXTS)} s(id, text) UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE text IS NOT NULL)"


def scanned(spark: SparkSession, d: str) -> DataFrame:
    own = sample(spark, samples.TEXTS, "id long, text string").select(F.concat(F.lit("s"), "id").alias("key"), "text")
    texts = spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null")
    return own.unionByName(texts.select(F.concat(F.lit("d"), "doc_id").alias("key"), "text"))


@query(f"SELECT key, {P.suspicious('text')} AS suspicious, least(1.0, 0.25 * len({P.matched('text')}))::DOUBLE AS risk, array_to_string({P.matched('text')}, ',') AS patterns FROM {_SCANNED} t")
def injection_report(spark: SparkSession, d: str) -> DataFrame:
    rows = scanned(spark, d).select("key", T.injection_report(F.col("text")).alias("r"))
    return rows.select("key", "r.suspicious", "r.risk", F.array_join(F.col("r.patterns").cast("array<string>"), ",").alias("patterns"))


@query(f"SELECT substr(key, 1, 1) AS kind, count(*) FILTER ({P.suspicious('text')}) AS quarantined, count(*) FILTER (NOT {P.suspicious('text')}) AS safe FROM {_SCANNED} t GROUP BY 1")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    bad = T.suspicious(F.col("text"))
    return scanned(spark, d).groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count_if(bad).alias("quarantined"), F.count_if(~bad).alias("safe"))


_LINES = r"regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]')"


@query(f"SELECT key, CASE WHEN {P.suspicious('text')} THEN '' ELSE {P.strip(f'array_to_string(list_filter({_LINES}, lambda x: NOT {P.suspicious(chr(120))}), chr(10))')} END AS safe FROM {_SCANNED} t")
def strip_injection_lines(spark: SparkSession, d: str) -> DataFrame:
    return scanned(spark, d).select("key", T.safe_lines(F.col("text")).alias("safe"))


_ASSIGNED = r"(?im)^\s*(?:OPENAI|OPENROUTER|GOOGLE)_API_KEY\s*=\s*[^\s#]{12,}\s*$"
_DUMMY = r"(?im)^\s*(?:OPENAI|OPENROUTER|GOOGLE)_API_KEY\s*=\s*(?:your-|replace|example|\.\.\.)"


@query(
    "SELECT id, label FROM (" + " UNION ALL ".join(
        f"SELECT id, {P.quoted(k)} AS label FROM {P.values(samples.SECRETS)} s(id, text) WHERE "
        + (f"regexp_matches(text, {P.quoted(p)})" if k != "assigned provider key" else f"regexp_matches(text, {P.quoted(_ASSIGNED)}) AND NOT regexp_matches(text, {P.quoted(_DUMMY)})")
        for k, p in V.SECRET_PATTERNS.items()
    ) + ")"
)
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return sample(spark, samples.SECRETS, "id int, text string").select("id", F.explode(T.secrets(F.col("text"))).alias("label"))


_LABELS = ", ".join(
    f"CASE WHEN {c} THEN {P.quoted(k)} END" for k, c in (
        (k, f"regexp_matches(text, {P.quoted(p)})" if k != "assigned provider key" else f"(regexp_matches(text, {P.quoted(_ASSIGNED)}) AND NOT regexp_matches(text, {P.quoted(_DUMMY)}))") for k, p in V.SECRET_PATTERNS.items()
    )
)


@query(f"SELECT key, array_to_string(list_filter([{_LABELS}], lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT 's' || id AS key, text FROM {P.values(samples.SECRETS)} s(id, text) UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents)")
def secret_report(spark: SparkSession, d: str) -> DataFrame:
    """A row for each sample and each document, with the labels of what it holds."""
    own = sample(spark, samples.SECRETS, "id long, text string").select(F.concat(F.lit("s"), "id").alias("key"), "text")
    texts = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    return own.unionByName(texts).select("key", F.array_join(T.secrets(F.col("text")), ",").alias("labels"))


@query()
def embedding_identities(spark: SparkSession, d: str) -> DataFrame:
    """The identity under which the vectors of the embedder at hand are cached, and of one that names none."""

    def other(docs, keys, text):
        return dense.hash_embedding(docs, keys, text)

    rows = [(name, dense.embedding_identity(f)) for name, f in (("hash", dense.hash_embedding), ("unnamed", other))]
    return spark.createDataFrame(rows, "embedder string, identity string")


@query(f"SELECT doc_id, {P.has_text('text', V.MOJIBAKE)} AS broken FROM documents WHERE text IS NOT NULL")
def mojibake_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.has_text(F.col("text"), V.MOJIBAKE).alias("broken"))


_VALID = "vec IS NOT NULL AND len(vec) > 0 AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"SELECT cache_identity, count(*) FILTER ({_VALID}) AS valid, count(*) AS n FROM vector_store GROUP BY 1")
def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    ok = dense.usable(F.col("vec"), F.col("dim"))
    return table(spark, d, "vector_store").groupBy("cache_identity").agg(F.count_if(ok).alias("valid"), F.count("*").alias("n"))


_FORCE = f"(SELECT * FROM embedding_cache WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY cache_identity, text_hash ORDER BY seq DESC) = 1)"


@query(f"SELECT cache_identity, text_hash, seq FROM {_FORCE}")
def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries in force."""
    return cache.in_force(table(spark, d, "embedding_cache")).select("cache_identity", "text_hash", "seq")


_HALF = "(SELECT (min(seq) + max(seq)) // 2 FROM embedding_cache)"


@query(
    f"WITH disk AS ({_FORCE[1:-1].replace('WHERE', f'WHERE seq <= {_HALF} AND', 1)}), memory AS ({_FORCE[1:-1].replace('WHERE', f'WHERE seq > {_HALF} AND', 1)}), dims AS (SELECT cache_identity, max(dim) AS dim FROM memory GROUP BY 1) "
    "SELECT cache_identity, text_hash, seq FROM memory UNION ALL SELECT cache_identity, text_hash, seq FROM disk d WHERE NOT EXISTS (SELECT 1 FROM dims x WHERE x.cache_identity = d.cache_identity AND x.dim <> d.dim) "
    "AND NOT EXISTS (SELECT 1 FROM memory m WHERE m.cache_identity = d.cache_identity AND m.text_hash = d.text_hash)"
)
def cache_merge(spark: SparkSession, d: str) -> DataFrame:
    """What was written in the later half of the cache, as memory, merged into the earlier half, as disk."""
    rows = table(spark, d, "embedding_cache")
    half = rows.agg(F.expr("(min(seq) + max(seq)) div 2").alias("half"))
    rows = rows.crossJoin(F.broadcast(half))
    disk, memory = (cache.in_force(rows.where(c).drop("half")) for c in ("seq <= half", "seq > half"))
    return cache.merge(disk, stage(memory, "memory")).select("cache_identity", "text_hash", "seq")


@query(
    f"WITH {P.CORPUS}, t AS (SELECT pos, sha256(content) AS h FROM corpus), held AS (SELECT text_hash FROM {_FORCE} WHERE cache_identity = 'hash-64') "
    "SELECT count(*) AS texts, count(*) FILTER (h IN (SELECT text_hash FROM held)) AS hits, (SELECT count(*) FROM held) + count(DISTINCT h) FILTER (h NOT IN (SELECT text_hash FROM held)) AS cached FROM t"
)
def cached_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The corpus embedded through the cache: texts, how many of them the cache held, and its entries of the identity
    afterwards."""
    force = stage(cache.in_force(table(spark, d, "embedding_cache")), "cache")
    texts = corpus(spark, d).select(F.col("pos").alias("key"), F.col("content").alias("text"))
    vectors, after = cache.embedded(texts, force)
    hits, _ = cache.lookup(texts.withColumn("text_hash", F.sha2("text", 256)), force, "hash-64")
    counts = [vectors.agg(F.count("*").alias("texts")), hits.agg(F.count("*").alias("hits")), after.where("cache_identity = 'hash-64'").agg(F.count("*").alias("cached"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query(f"SELECT cache_identity, text_hash, seq FROM {_FORCE} QUALIFY row_number() OVER (PARTITION BY cache_identity ORDER BY seq DESC) <= 100")
def cache_evict(spark: SparkSession, d: str) -> DataFrame:
    return cache.evict(cache.in_force(table(spark, d, "embedding_cache")), 100).select("cache_identity", "text_hash", "seq")


@query(
    f"WITH {P.CORPUS}, held AS (SELECT text_hash FROM {_FORCE} WHERE cache_identity = 'hash-64') "
    "SELECT sha256(content) IN (SELECT text_hash FROM held) AS hit, count(*) AS texts FROM corpus GROUP BY 1"
)
def cache_hits_misses(spark: SparkSession, d: str) -> DataFrame:
    texts = corpus(spark, d).select("pos", F.sha2("content", 256).alias("text_hash"))
    hits, misses = cache.lookup(texts, cache.in_force(table(spark, d, "embedding_cache")), "hash-64")
    both = hits.select(F.lit(True).alias("hit")).unionByName(misses.select(F.lit(False).alias("hit")))
    return both.groupBy("hit").agg(F.count("*").alias("texts"))


def _chunk_sql(size: int, overlap: int) -> str:
    def last(sep: str) -> str:
        return f"nullif(length(regexp_extract(w, '(?s)^(.*{sep})', 1)), 0) + s + {size // 2}"

    ends = ", ".join(last(x) for x in ("\\n\\n", "\\n", "\\. ", " "))
    return f"""WITH RECURSIVE {P.CORPUS}, cut AS (
      SELECT pos, content, 0 AS no, 0 AS s, CASE WHEN length(content) <= {size} THEN length(content) ELSE coalesce({ends.replace('w', "substr(content, 1 + " + str(size // 2) + ", " + str(size - size // 2) + ")").replace('+ s +', '+ 0 +')}, {size}) END AS e FROM corpus
      UNION ALL
      SELECT pos, content, no + 1, s, CASE WHEN length(content) - s <= {size} THEN length(content) ELSE coalesce({ends}, s + {size}) END FROM (
        SELECT pos, content, no, greatest(e - {overlap}, s + 1) AS s, substr(content, greatest(e - {overlap}, s + 1) + 1 + {size // 2}, {size - size // 2}) AS w FROM cut WHERE e < length(content)))
    , kept AS (SELECT pos, no, s, e, substr(content, s + 1, e - s) AS p FROM cut)
    SELECT pos, no::INT AS chunk_no, (s + length(p) - length(regexp_replace(p, '^{P.WS}+', '')))::INT AS char_start,
      (s + length(p) - length(regexp_replace(p, '^{P.WS}+', '')) + length({P.strip('p')}))::INT AS char_end, md5({P.strip('p')}) AS digest FROM kept WHERE {P.strip('p')} <> ''"""


def _chunks(spark: SparkSession, d: str, sizes: tuple[int, int]) -> DataFrame:
    return chunking.chunks(corpus(spark, d), *sizes, ["pos"]).select("pos", "chunk_no", "char_start", "char_end", F.md5("chunk").alias("digest"))


@query(_chunk_sql(*V.PARENT_CHUNK))
def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, V.PARENT_CHUNK)


@query(_chunk_sql(*V.CHILD_CHUNK))
def child_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, V.CHILD_CHUNK)


@query(f"SELECT pos, count(*) AS n, max(char_end - char_start) AS longest FROM ({_chunk_sql(*V.CHILD_CHUNK)}) GROUP BY pos")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, V.CHILD_CHUNK).groupBy("pos").agg(F.count("*").alias("n"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"))


@query(f"SELECT id, CASE WHEN regexp_matches(regexp_replace(text, '^{P.WS}+', ''), '^[=+\\-@]') THEN '''' || text ELSE text END AS safe FROM {P.values(samples.FORMULAS)} s(id, text)")
def csv_safe_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.csv_rows(sample(spark, samples.FORMULAS, "id int, text string")).select("id", F.col("text").alias("safe"))


_SAFE = lambda x: f"CASE WHEN regexp_matches(regexp_replace({x}, '^{P.WS}+', ''), '^[=+\\-@]') THEN '''' || {x} ELSE {x} END"


@query(f"WITH {P.QUESTIONS} SELECT query_id, {_SAFE('query')} AS query, {_SAFE('context')} AS context, to_json({P.ANSWERS})::VARCHAR AS answers FROM asked")
def csv_safe_questions(spark: SparkSession, d: str) -> DataFrame:
    return sinks.csv_rows(D.questions(table(spark, d, "questions")))


def _truncate_sql(x: str, n: int) -> str:
    head = f"substr({x}, 1, {n - len(V.TRUNCATED)})"
    word = f"rtrim(regexp_replace({head}, ' [^ ]*$', ''))"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE (CASE WHEN length({word}) > 0 THEN {word} ELSE rtrim({head}) END) || {P.quoted(V.TRUNCATED)} END"


@query(f"SELECT doc_id, {_truncate_sql('text', 200)} AS short FROM documents WHERE text IS NOT NULL")
def truncate_marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.truncate(F.col("text"), 200).alias("short"))
