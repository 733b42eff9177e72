"""Quality rules with cross-document line frequency (native).

Base rules look at one text: words, characters, symbols, repeated lines, words in repeated 8-word windows. Then each
normalised line is hashed and its distinct documents on its host are counted; lines above the limits are removed and a
document that keeps too little of itself is rejected. Equal texts on a host are one document of it, so that exact copies
don't make their own lines boilerplate; edited copies are documents of their own.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows get
equal rows; an empty table gives an empty result; no column but the id, text and host is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD, cut, own_columns, text_key, unused, without_white

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is above the limits on a host if its distinct documents are more than LINE_DOCS and than LINE_SHARE of the
#: host's.
LINE_DOCS = 50
LINE_SHARE = 0.01
#: A document is depleted if less than this share of its word characters is left.
MIN_LEFT = 0.2


def _pairs(a: Column, step: int) -> Column:
    """Hashes of (a[i], a[i + step])."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def _covered(starts: Column) -> Column:
    """Words that windows at the sorted `starts` cover together."""
    n = F.greatest(F.size(starts) - 1, F.lit(0))
    steps = F.zip_with(F.slice(starts, F.lit(1), n), F.slice(starts, F.lit(2), n), lambda x, y: F.least(y - x, F.lit(WINDOW)))
    return F.when(F.size(starts) > 0, F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)


def _line_key(line: Column) -> Column:
    """Hash of a normalised line: lower case, runs of white space as one space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def text_rules(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, host, text) with the base columns and the arrays line_hash and line_chars.

    Arrays that a later step reads twice are columns of their own, so that each is computed once.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "host", text.alias("text")).select("doc_id", "host", "text", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    stripped = F.col("text")
    for c in SYMBOLS:
        stripped = F.replace(stripped, F.lit(c), F.lit(""))
    d = d.select(
        "doc_id", "host", F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("h1"), F.char_length(without_white(F.col("text"))).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(stripped)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", _line_key).alias("line_hash"), F.transform("lines", lambda x: F.char_length(without_white(x))).alias("line_chars"), text_key(F.col("text")).alias("text_hash"),
    )
    base = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "line_hash", "line_chars", "text_hash"]
    d = d.withColumn("n_words", F.size("h1").cast("long")).select(*base, _pairs(F.col("h1"), 1).alias("h2"))
    d = d.select(*base, _pairs(F.col("h2"), 2).alias("h4"))
    d = d.select(*base, _pairs(F.col("h4"), 4).alias("h8"))
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*base, F.when(repeats, F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("s"))
    d = d.select(*base, "s", F.zip_with("s", F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))).alias("n"))
    before = F.concat(F.array(F.lit(False)), F.slice("n", F.lit(1), F.greatest(F.size("n") - 1, F.lit(0))))
    found = F.filter(F.arrays_zip(F.col("s.i").alias("i"), F.col("n").alias("n"), before.alias("p")), lambda x: x["n"] | x["p"])
    d = d.select(*base, F.sort_array(F.transform(found, lambda x: x["i"])).alias("starts"))
    return d.select(*base, _covered(F.col("starts")).cast("long").alias("n_repeat_words"))


def _decided(docs: DataFrame, doc_id: str, text: str, host: str, line_docs: int, line_share: float, min_left: float) -> DataFrame:
    """What `quality_rules` returns, with host and gone: the keys of the document's lines above the limits, or null."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    ruled = text_rules(own_columns(docs, doc_id=doc_id, host=host, text=text))
    d = cut(ruled.select(F.monotonically_increasing_id().alias("row"), "*", failed.alias("base_failed")))
    texts = d.select("host", "text_hash", "line_hash").dropDuplicates(["host", "text_hash"])
    per_line = texts.select("host", F.explode(F.array_distinct("line_hash")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    frequent = per_line.filter(F.col("docs") > line_docs)
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "_host")
    above = cut(frequent.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("docs") > line_share * F.col("host_docs")).select("_host", F.col("line").alias("_line")))  # so that the join's hot side can be split
    lines = d.filter("!base_failed").select("row", "host", F.explode(F.arrays_zip("line_hash", "line_chars")).alias("x")).select("row", "host", F.col("x.line_hash").alias("line"), F.col("x.line_chars").alias("chars"))
    hit = lines.join(above, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line"))).groupBy(F.col("row").alias("_row")).agg(F.sum("chars").alias("removed"), F.collect_set("line").alias("gone"))  # a document's own lines at most
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (F.col("word_chars") - removed >= min_left * F.col("word_chars"))
    return d.join(hit, F.col("row") == F.col("_row"), "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", removed.alias("removed_chars"), "base_failed", kept.alias("kept"), F.col("text_hash").alias("text_key"), "host", "gone")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: doc_id, the base columns, removed_chars, base_failed, kept, text_key (of the text, a null one as empty).

    removed_chars counts the word characters of the lines above the limits; it is 0 where the base rules fail already.
    """
    return _decided(docs, doc_id, text, host, line_docs, line_share, min_left).drop("host", "gone")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of `docs` that the rules keep, their texts without the lines above the limits.

    Where lines go, the column `n_chars` (if there is one) counts what is left; other texts stay as they are.
    """
    decided = _decided(docs, doc_id, text, host, line_docs, line_share, min_left).filter("kept")
    k_id, k_text, k_host, k_gone, k_left = unused(docs, "id", "text", "host", "gone", "left")
    one = decided.select(F.col("doc_id").alias(k_id), F.col("text_key").alias(k_text), F.col("host").alias(k_host), F.col("gone").alias(k_gone)).dropDuplicates([k_id, k_text, k_host])  # equal rows, equal decisions
    own_id, own_text, own_host = (F.col(f"`{c}`") for c in (doc_id, text, host))
    joined = docs.join(one, own_id.eqNullSafe(F.col(k_id)) & (text_key(own_text) == F.col(k_text)) & own_host.eqNullSafe(F.col(k_host)))
    left = F.array_join(F.filter(F.split(own_text, "\n"), lambda x: ~F.array_contains(F.col(k_gone), _line_key(x))), "\n")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], k_gone, F.when(F.col(k_gone).isNull(), own_text).otherwise(left).alias(k_left))
    new = {text: F.col(k_left)}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col(k_gone).isNull(), F.col(f"`{n_chars}`")).otherwise(F.char_length(k_left).cast(docs.schema[n_chars].dataType))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
