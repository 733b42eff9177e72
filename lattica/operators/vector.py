"""Search over embedded document chunks: scope, top-k, coverage, statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.functions.text import excerpt, unspaced
from lattica.functions.values import cosine
from lattica.operators.federate import max_score
from lattica.operators.joins import keyed, nested_sets

MOST_HITS, FLOOR, MOST_IDS, MOST_QUERIES = 20, 0.45, 50, 3


def scope(products: DataFrame, wanted: list[str]) -> DataFrame:
    """product_id of products whose key, name or short name is among the wanted values; over MOST_IDS of them are joined."""
    values = list(dict.fromkeys(wanted))
    if len(values) > MOST_IDS:
        asked = products.sparkSession.createDataFrame([(v,) for v in values], "_wanted string")
        names = products.select("product_id", F.explode(F.array_distinct(F.array("source_key", "name", "short_name"))).alias("_name"))
        return names.join(asked, F.col("_name") == F.col("_wanted"), "left_semi").select("product_id").distinct()
    return products.filter(F.col("source_key").isin(values) | F.col("name").isin(values) | F.col("short_name").isin(values)).select("product_id").distinct()


def embedded(chunks: DataFrame, embeddings: DataFrame, model: str, dimension: int) -> DataFrame:
    """Chunks with their vectors of one model: equal content hash and model, and revision with nulls meeting."""
    own = embeddings.filter((F.col("embedding_model") == model) & (F.col("embedding_dim") == dimension))
    return keyed(chunks.filter(F.col("embedding_model") == model), own.drop("embedding_dim"), ["content_hash", "embedding_model"], ["model_revision"])


def in_scope(chunks: DataFrame, bridge: DataFrame, products: DataFrame) -> DataFrame:
    """Chunks of documents that belong to a product in scope."""
    documents = bridge.join(products.select("product_id"), "product_id", "left_semi").select("document_id")
    return chunks.join(documents, "document_id", "left_semi")


def top_k(chunks: DataFrame, query: list[float], k: int, sections: list[str] | None = None, vector: str = "embedding", key: str = "chunk_id", section: str = "section_type") -> DataFrame:
    """The k (1 to 20) chunks most like the query, best first, ties by key. Each partition keeps k; only those meet."""
    if not query:
        raise RequestError("an empty query vector")
    rows = chunks.filter(F.col(section).isin(sections)) if sections else chunks
    scored = rows.withColumn("score", cosine(F.col(vector), query))  # once a row; what has no score comes last and goes
    return scored.orderBy(F.col("score").desc_nulls_last(), key).limit(max(1, min(k, MOST_HITS))).filter("score is not null")


def search(chunks: DataFrame, queries: list[list[float]], k: int, bridge: DataFrame | None = None, sections: list[str] | None = None, floor: float = FLOOR) -> DataFrame:
    """Hits of one to MOST_QUERIES queries (more are an error), each chunk once with its best score, none below the floor, with its products nested.

    Products are nested after the top-k, so that a document of many products is scored once.
    """
    if not 1 <= len(queries) <= MOST_QUERIES:
        raise RequestError(f"{len(queries)} queries; 1 to {MOST_QUERIES} are searched at a time")
    hits = reduce(DataFrame.unionByName, [top_k(chunks, q, k, sections).drop("embedding") for q in queries])
    best = max_score(hits, "chunk_id", "score").filter(F.col("score") >= floor)
    return nested_sets(best, bridge, "document_id", "product_id", "product_ids") if bridge is not None else best


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return hits.join(documents, "document_id", "left")


def normalised(hits: DataFrame, texts: list[str]) -> DataFrame:
    """Texts never null, scores rounded to three places."""
    own = hits.withColumns({c: F.coalesce(c, F.lit("")) for c in texts if c in hits.columns})
    return own.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 3))


def coverage(products: DataFrame, states: DataFrame) -> DataFrame:
    """(product_id, status): an absent row is "unknown", not "none"."""
    return products.select("product_id").join(states.select("product_id", "status"), "product_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def coverage_histogram(covered: DataFrame) -> DataFrame:
    bucket = F.when(F.col("status").startswith("matched"), "matched").when(F.col("status").isin("unavailable", "download_failed"), F.col("status")).otherwise("unknown")
    return covered.groupBy(bucket.alias("status")).agg(F.count("*").alias("n"))


def search_status(scoped: int | None, histogram: dict[str, int], hits: int, raw_hits: int, topics: bool) -> str:
    """Why a search has or hasn't an answer, from counts: products in scope (None: not asked for), coverage, hits over
    the floor and before it."""
    if scoped == 0:
        return "no_product_match"
    if scoped and not histogram.get("matched"):
        return "no_official_document" if histogram.get("unavailable") == scoped else "no_document"
    if hits:
        return "ok"
    if raw_hits:
        return "low_confidence"
    return "topic_not_covered" if topics else "no_hit"


def phrase_search(documents: DataFrame, chunks: DataFrame, phrase: str, kinds: list[str], k: int = MOST_HITS) -> DataFrame:
    """Documents of some kinds whose title or a chunk holds a phrase, blanks and case aside; newest first. Documents without chunks count."""
    needle = phrase.replace(" ", "").lower()
    if not needle:
        raise RequestError("an empty phrase")
    rows = documents.filter(F.col("source_type").isin(kinds)).join(chunks.select("document_id", "chunk_id", "chunk_text"), "document_id", "left")
    found = rows.filter(unspaced(F.concat_ws(" ", "title", "chunk_text")).contains(needle))
    return found.orderBy(F.col("published_at").desc_nulls_last(), "document_id", "chunk_id").limit(max(1, min(k, MOST_HITS)))


def sections_for(labels: list[str], hints: dict[str, str]) -> list[str]:
    """Sections that the requested labels hint at, by the words in them."""
    return list(dict.fromkeys(s for x in labels for word, s in hints.items() if word in x))


def quotes(hits: DataFrame, text: str, budget: int = 240) -> DataFrame:
    """`hits` with a quote of each: its first 25 words, as far as the characters that its document has left; best hits first."""
    own = hits.withColumn("_q", excerpt(F.col(text), 25, budget))
    earlier = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum(F.length("_q")).over(earlier), F.lit(0)), F.lit(0))
    return own.withColumn("quote", F.substr(F.col("_q"), F.lit(1), left)).drop("_q")
