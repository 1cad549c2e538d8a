"""Full-text search: a field-weighted inverted index as a table, and BM25 over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import analyze, path_words, query_weights, stem, truncate
from ..session import spread, stored

WEIGHTS = {"title": 3, "keywords": 2, "body": 1}
K1, B, TITLE_BOOST, IDENTIFIER_BOOST = 1.2, 0.75, 1.35, 0.9


def _once(rows: DataFrame, *made) -> DataFrame:
    """``id`` and the columns ``made``, each evaluated once a row: a generator isn't merged with the projections after
    it, as a plain projection would be, whose arrays would be made anew wherever a lambda names them."""
    return rows.select("id", F.inline(F.array(F.struct(*made))))


def term_rows(documents: DataFrame) -> DataFrame:
    """``id, length, terms`` of ``documents`` (id, title, keywords array, body): terms are structs of term, tf and
    in_title, length is the sum of tf. A field counts a term once, each entry of keywords is a field; frequencies are
    field weights. Null fields are empty. All of it is made inside the row: nothing is shuffled."""
    empty = F.array().cast("array<string>")
    title = F.coalesce(analyze(F.col("title"), True), empty).alias("title")
    keys = F.coalesce(F.flatten(F.transform(F.coalesce("keywords", empty), lambda k: F.coalesce(analyze(k, True), empty))), empty).alias("keys")
    body = F.coalesce(analyze(F.col("body"), True), empty).alias("body")
    rows = _once(spread(documents), title, keys, body)

    def entry(t, in_body: int):
        named = F.array_contains("title", t)
        tf = F.when(named, WEIGHTS["title"]).otherwise(0) + WEIGHTS["keywords"] * F.size(F.filter("keys", lambda k: k == t)) + WEIGHTS["body"] * in_body
        return F.struct(t.alias("term"), tf.cast("long").alias("tf"), named.alias("in_title"))

    elsewhere = F.array_except(F.array_distinct(F.concat("title", "keys")), F.col("body"))
    rows = _once(rows, F.concat(F.transform("body", lambda t: entry(t, 1)), F.transform(elsewhere, lambda t: entry(t, 0))).alias("terms"))
    return rows.select("id", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["tf"]).alias("length"), "terms")


@dataclass
class Index:
    """The documents and, of each, its terms and length. Ids are unique; a repeated one is a document of its own."""

    documents: DataFrame
    rows: DataFrame

    @classmethod
    def build(cls, documents: DataFrame) -> Index:
        return cls(documents, term_rows(documents))

    @property
    def postings(self) -> DataFrame:
        """``id, term, tf, in_title``: the inverted index as a table."""
        return self.rows.select("id", F.explode("terms").alias("t")).select("id", "t.*")


def search(index: Index, query: str, limit: int | None = 10, types: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """``id, score, matched`` of the best documents, best first, equal scores by id. ``limit`` None: all.

    The terms of a document are filtered to those of the query (a few, known on the driver) inside its row; what is
    left is written to the shared folder once, a length and a few terms per document, and gives hits, frequencies and
    the corpus numbers. Those are one row, and frequencies a row per term of the query, joined by broadcast."""
    weights = query_weights(query)
    spark = index.documents.sparkSession
    if not weights:
        return spark.createDataFrame([], "id string, score double, matched array<string>")
    terms = spark.createDataFrame([(t, float(w)) for t, w in weights.items()], "term string, weight double")
    docs = index.documents if types is None else index.documents.filter(F.col("type").isin(types))
    near = stored(index.rows.select("id", "length", F.filter("terms", lambda x: x["term"].isin(list(weights))).alias("hits")))
    hits = near.select("id", "length", F.explode("hits").alias("h")).select("id", "length", "h.*")
    corpus = near.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    t = terms.join(F.broadcast(df), "term", "left")
    n = F.col("n")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - B + B * F.col("length") / F.greatest(F.col("total") / n, F.lit(1.0))
    tf = F.col("tf").cast("double")
    scored = hits.join(F.broadcast(t), "term").crossJoin(F.broadcast(corpus)).select("id", "term", (idf * tf * (K1 + 1) / (tf + K1 * norm) * F.col("weight")).alias("s"), "in_title")
    # a term that stands only in the words of the name's path
    words = docs.select("id", F.explode(F.array_distinct(F.concat(path_words(F.coalesce("title", F.lit(""))), analyze(F.coalesce("title", F.lit("")), True)))).alias("word"))
    named = words.join(F.broadcast(t.withColumn("stem", stem(F.col("term")))), (F.col("word") == F.col("term")) | (F.col("word") == F.col("stem"))).groupBy("id", "term").agg(F.first("weight").alias("weight"), F.first("df").alias("df"))
    named = named.join(hits.select("id", "term"), ["id", "term"], "left_anti").select("id", "term", (F.when(F.col("df").isNull(), 0.6).otherwise(0.3) * F.col("weight")).alias("s"), F.lit(False).alias("in_title"))
    sums = scored.unionByName(named).groupBy("id").agg(F.sum("s").alias("s"), F.sum(F.col("in_title").cast("int")).alias("boosts"), F.array_sort(F.collect_set("term")).alias("matched"))
    place = path_words(F.coalesce("title", F.lit("")))
    out = docs.select("id", place.alias("place")).join(sums, "id").withColumn("score", F.col("s") * F.pow(F.lit(TITLE_BOOST), F.col("boosts")) + F.size(F.filter("matched", lambda m: F.array_contains(F.col("place"), m))) * IDENTIFIER_BOOST)
    out = out.filter((F.col("score") > 0) & (F.col("score") >= min_score)).select("id", F.round("score", 4).alias("score"), "matched")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def results(found: DataFrame, documents: DataFrame, terms: int, backend: str = "bm25") -> DataFrame:
    """Found documents as rows for a reader: the id in its two parts, title, snippet, why."""
    why = F.concat(F.lit("matched "), F.size("matched").cast("string"), F.lit(f" of {terms} query terms ("), F.array_join("matched", ", "), F.lit(")"))
    return found.join(documents.select("id", "title", "body"), "id").select("id", F.substring_index("id", ":", 1).alias("type"), F.regexp_extract("id", r"^[^:]*:(.*)$", 1).alias("name"), "title", "score", truncate(F.col("body"), 160).alias("snippet"), why.alias("reason"), F.lit(backend).alias("backend"))


Backend = Callable[[Index, str], DataFrame]
Reranker = Callable[[str, DataFrame], DataFrame]


@dataclass
class SearchService:
    """A backend that finds, and optionally a reranker over what it found; both take and give DataFrames."""

    index: Index
    backend: Backend = search
    reranker: Reranker | None = None
    name: str = "bm25"

    def query(self, text: str, **options) -> DataFrame:
        found = self.backend(self.index, text, **options)
        if self.reranker:
            found = self.reranker(text, found)
        return results(found, self.index.documents, len(query_weights(text)), self.name).orderBy(F.desc("score"), "id")
