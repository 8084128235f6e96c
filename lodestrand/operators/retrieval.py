"""Hybrid retrieval of many queries at once: dense and sparse lists, fusion, diversity, quarantine, backfill, quality."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab
from lodestrand.operators import dense, fusion, pooling, sparse
from lodestrand.session import stage

SHOWN = ["unit", "key", "content", "label", "origin", "doc_id", "bad"]


def with_keys(units: DataFrame) -> DataFrame:
    """Adds the tokens as ``words`` between blanks, the ``risk``, ``bad`` (suspicious), the ``origin`` where missing, and the
    ``key`` by which equal texts of one origin meet."""
    if "origin" not in units.columns:
        units = units.withColumn("origin", F.col("label"))
    units = units.withColumn("words", words(F.col("content"))).withColumn("risk", T.risk(F.col("content")))
    return units.withColumn("bad", F.col("risk") > 0).withColumn("key", fusion.document_key(F.col("content"), F.col("origin")))


def words(c: Column) -> Column:
    return F.array_join(T.tokens(F.coalesce(c, F.lit(""))), " ")


@dataclass
class Index:
    """Units of text that all queries search (unit, content, label, doc_id ...), their postings and unit vectors, each
    written once. ``embed`` makes the vectors of units and of queries."""

    units: DataFrame
    posts: DataFrame
    vectors: DataFrame
    embed: dense.Embedder = dense.hash_embedding

    @staticmethod
    def build(units: DataFrame, embed: dense.Embedder = dense.hash_embedding) -> Index:
        units = stage(with_keys(units), "units")
        posts = stage(sparse.postings(units, "unit", "content"), "unit-postings")
        return Index(units, posts, stage(embed(units, ["unit"], "content"), "unit-vectors"), embed)

    def count(self) -> int:
        return self.units.count()

    def sized(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("n", F.lit(self.count()).cast("long"))

    def lists(self, asked: DataFrame) -> DataFrame:
        """(query_id, variant_no, kind, unit, rank) of (query_id, variant_no, variant, pool): kind 0 is the dense list
        as the vectors rank it, kind 1 the sparse one, each cut at the query's ``pool``."""
        keys = ["query_id", "variant_no"]
        most = asked.agg(F.max("pool")).first()[0] or 0
        pools = asked.select(*keys, "pool")
        near = dense.search(self.embed(asked, keys, "variant"), self.vectors, most, keys, "unit").withColumn("kind", F.lit(0))
        found = sparse.search(asked.select(*keys, F.col("variant").alias("query")), self.units, most, keys, "unit", "content", self.posts)
        both = near.unionByName(found.withColumn("kind", F.lit(1))).join(pools, keys)
        return both.where(F.col("rank") <= F.col("pool")).select(*keys, "kind", "unit", "rank")

    def rows(self, asked: DataFrame) -> DataFrame:
        """Rows of ``pooling`` that tell of the variants, what their lists name, and the lists."""
        lists = stage(self.lists(asked), "lists")
        named = lists.select("query_id", "unit").distinct().join(self.units.select("unit", "key", "words", "risk"), "unit")
        rows = pooling.told(asked.withColumn("words", words(F.col("variant"))), pooling.VARIANT, variant_no="variant_no", n="pool", words="words")
        rows = rows.unionByName(pooling.told(named, pooling.UNIT, unit="unit", key="key", words="words", risk="risk"))
        return rows.unionByName(pooling.told(lists, pooling.PLACE, variant_no="variant_no", kind="kind", unit="unit", n="rank"))

    def shown(self, picks: DataFrame) -> DataFrame:
        return picks.join(self.units.select(*SHOWN), "unit")


@dataclass
class OwnUnits:
    """Units of each query's own (query_id, unit, content ...), searched by that query alone and by their own statistics.
    A query's units are as few as the chunks of the parents it selected."""

    units: DataFrame
    vectors: DataFrame
    embed: dense.Embedder = dense.hash_embedding

    @staticmethod
    def build(units: DataFrame, embed: dense.Embedder = dense.hash_embedding) -> OwnUnits:
        units = stage(with_keys(units), "own-units")
        return OwnUnits(units, stage(embed(units, ["query_id", "unit"], "content"), "own-vectors"), embed)

    def sized(self, queries: DataFrame) -> DataFrame:
        """A query without a unit isn't searched and has no row."""
        return queries.join(self.units.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")

    def rows(self, asked: DataFrame) -> DataFrame:
        """Rows of ``pooling`` that tell of the variants and of the units of their queries."""
        keys = ["query_id", "variant_no"]
        variants = asked.withColumn("words", words(F.col("variant"))).join(self.embed(asked, keys, "variant"), keys)
        rows = pooling.told(variants, pooling.VARIANT, variant_no="variant_no", n="pool", words="words", vec="vec")
        units = self.units.join(asked.select("query_id").distinct(), "query_id", "left_semi").join(self.vectors, ["query_id", "unit"])
        return rows.unionByName(pooling.told(units, pooling.UNIT, unit="unit", key="key", words="words", risk="risk", vec="vec"))

    def shown(self, picks: DataFrame) -> DataFrame:
        return picks.join(self.units.select("query_id", *SHOWN), ["query_id", "unit"])


_prepared: OrderedDict[tuple, Index] = OrderedDict()


def prepared(key: tuple, build, most: int = vocab.INDEX_CACHE) -> Index:
    """The index under ``key`` (the corpus' fingerprint, the sizes of its units and the embedder), built where it isn't
    known; the ``most`` last used ones are kept. Its tables stay until the process ends."""
    if key not in _prepared:
        _prepared[key] = build()
    _prepared.move_to_end(key)
    while len(_prepared) > most:
        _prepared.popitem(last=False)
    return _prepared[key]


def with_relevance(rows: DataFrame) -> DataFrame:
    """Adds ``toks`` of the content and ``relevance`` to the query."""
    rows = rows.withColumn("toks", T.tokens(F.col("content"))).withColumn("risk", T.risk(F.col("content")))
    return rows.withColumn("relevance", T.let(T.tokens(F.col("query")), lambda q: T.relevance(q, F.col("toks"), F.col("risk")))).drop("risk")


def candidates(asked: DataFrame, corpus: Index | OwnUnits) -> DataFrame:
    """The pool of every query: (query_id, rank, score and the units' columns), the lists of its variants fused by content
    and origin and cut at its ``pool``. ``asked`` has (query_id, variant_no, variant, pool).

    The dense lists are reranked by words before they are fused. What the lists name, its tokens and its risk are brought
    to the query once, and the query is worked off in one place."""
    pool = pooling.by_query(corpus.rows(asked), pooling.pooled, ("rank", "score"), isinstance(corpus, OwnUnits))
    return corpus.shown(pool)


def picked(queries: DataFrame, asked: DataFrame, corpus: Index | OwnUnits) -> DataFrame:
    """(query_id, pick_no, relevance and the units' columns): the ``k`` diverse ones of the ``candidates`` of each query.
    ``queries`` has (query_id, query, k)."""
    query = pooling.told(queries.withColumn("words", words(F.col("query"))), pooling.QUERY, n="k", words="words")
    rows = query.join(asked.select("query_id").distinct(), "query_id", "left_semi").unionByName(corpus.rows(asked))
    return corpus.shown(pooling.by_query(rows, pooling.diverse, ("pick_no", "relevance"), isinstance(corpus, OwnUnits)))


def hybrid(queries: DataFrame, variants: DataFrame, corpus: Index | OwnUnits, k: str = "k") -> DataFrame:
    """``picked`` with a pool of 2 ``k``, of all units where these are fewer, and of ``k`` at least. ``queries`` has
    (query_id, query, k), ``variants`` (query_id, variant_no, variant)."""
    sized = corpus.sized(queries.select("query_id", "query", F.col(k).alias("k")))
    pool = F.greatest(F.col("k"), F.least(F.col("k") * 2, F.col("n")))
    asked = stage(variants.join(sized.select("query_id", pool.cast("int").alias("pool")), "query_id"), "asked")
    return picked(queries.select("query_id", "query", F.col(k).alias("k")), asked, corpus)


def safe_with_backfill(queries: DataFrame, variants: DataFrame, corpus: Index | OwnUnits, k: str = "k") -> tuple[DataFrame, DataFrame]:
    """(documents, counts): units that aren't suspicious, ``k`` a query. A query left with fewer, of a corpus that has
    more, is searched again with a wider pool, which is ranked afresh; what both searches found is joined in order of
    arrival, a content once. ``counts`` has (query_id, quarantined, searches): the suspicious contents seen and 1 or 2."""
    asked = queries.select("query_id", "query", F.col(k).alias("k"))
    first = stage(hybrid(asked, variants, corpus), "first-search")
    got = first.groupBy("query_id").agg(F.count_if(~F.col("bad")).alias("safe"), F.count("*").alias("raw"))
    seen = corpus.sized(asked).join(got, "query_id", "left")
    short = seen.where((F.coalesce("safe", F.lit(0)) < F.col("k")) & (F.col("n") > F.coalesce("raw", F.lit(0))))
    wide = F.least(F.col("n"), F.greatest(F.col("k") * 4, F.col("k") + 8)).cast("int")
    short = stage(short.select("query_id", "query", wide.alias("k")), "short-of-safe")
    both = first.withColumn("search", F.lit(1))
    if not short.isEmpty():
        again = hybrid(short, variants.join(short.select("query_id"), "query_id"), corpus)
        both = both.unionByName(again.withColumn("search", F.lit(2)))
    flagged = both.join(short.select("query_id", F.lit(True).alias("twice")), "query_id", "left")
    same = F.when(F.col("twice"), F.col("content")).otherwise(F.col("unit").cast("string"))  # one search keeps equal contents
    once = fusion.first_of(flagged.withColumn("same", same), ["query_id", "same"], ["search", "pick_no"]).drop("same", "twice")
    once = stage(once, "both-searches")
    bad = once.where("bad").groupBy("query_id").agg(F.countDistinct("content").alias("quarantined"))
    counts = asked.select("query_id").join(bad, "query_id", "left")
    counts = counts.join(short.select("query_id").withColumn("searches", F.lit(2)), "query_id", "left")
    counts = counts.select("query_id", F.coalesce("quarantined", F.lit(0)).alias("quarantined"), F.coalesce("searches", F.lit(1)).alias("searches"))
    order = Window.partitionBy("query_id").orderBy("search", "pick_no")
    kept = once.where(~F.col("bad")).withColumn("rank", F.row_number().over(order)).join(asked.select("query_id", "k"), "query_id")
    return kept.where(F.col("rank") <= F.col("k")).select("query_id", "rank", "unit", "content", "label", "origin", "doc_id", "relevance"), counts


def quality(queries: DataFrame, docs: DataFrame, counts: DataFrame | None = None, weak: bool = True) -> DataFrame:
    """(query_id, status, max_relevance, avg_relevance, suspicious, quarantined, duplicate_rate, scores) of every query's
    documents (query_id, rank, content, relevance), ``scores`` being their relevance in order of rank. ``counts`` has the
    suspicious contents that were left out before; without ``weak`` a result of little relevance is good too."""
    toks = docs.select("query_id", "rank", T.tokens(F.col("content")).alias("toks"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "relevance"))), lambda x: x["relevance"])
    sums = docs.groupBy("query_id").agg(F.count("*").alias("n"), F.max("relevance").alias("top"), F.avg("relevance").alias("mean"), F.count_if(T.suspicious(F.col("content"))).alias("bad"), listed.alias("scores"))
    rows = queries.select("query_id").join(sums, "query_id", "left").join(fusion.duplicate_rate(toks, ["query_id"]), "query_id", "left")
    if counts is not None:
        rows = rows.join(counts.select("query_id", "quarantined"), "query_id", "left")
    else:
        rows = rows.withColumn("quarantined", F.lit(0))
    left_out = F.coalesce("quarantined", F.lit(0)).cast("long")
    bad = (F.coalesce("bad", F.lit(0)) + left_out).cast("long")
    n, top = F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0))
    status = (
        F.when((n == 0) & (bad > 0), "suspicious_context_blocked").when(n == 0, "empty").when(bad > 0, "suspicious_context_quarantined")
        .when(F.lit(weak) & (top < vocab.WEAK_RELEVANCE), "weak").otherwise("good")
    )
    return rows.select(
        "query_id", status.alias("status"), top.alias("max_relevance"), F.coalesce("mean", F.lit(0.0)).alias("avg_relevance"), bad.alias("suspicious"),
        left_out.alias("quarantined"), F.coalesce("duplicate_rate", F.lit(0.0)).alias("duplicate_rate"), F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
    )
