"""Operator 7 [native]: benchmark decontamination as a prefix-filtered set join, DataFrame functions only.

A window is `width` consecutive words of a benchmark item (a shorter item is one window). A document contains it
exactly if all its words occur, so ordered by rarity the necessary prefix of a window is one token: its rarest
word. Frequencies of the benchmark's words are counted over all documents. Occurrences of those prefix tokens in
documents join the windows on the token; the place of the token in the window bounds the start and the end
(positional and length filter), and the words from that start are compared with the whole window.

Words are compared in the form of the contract (A-Z lower-cased). The join key is the locale's lower case, which
maps words that are equal in that form to equal keys, so it loses nothing; the comparison then decides.

Broadcast: only while the benchmark's text is at most `broadcast_bytes` (measured each time); above that the join
is on slim rows (key, place) by shuffle and documents are joined back for the comparison.

Nulls: a null text has no words; rows with a null item_id are no items; a null doc_id is an id of its own.
Repeated rows (same id, same text) each get the same result. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm.common import cut, quoted, table

#: What separates words and what is in them before letters are folded (Java patterns); the letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """Distinct windows: window (words joined by blanks), parts (words), items (sorted ids as strings)."""
    words = F.filter(F.split(fold(F.col("text")), SEPARATORS), lambda w: w != "")
    return (
        benchmark.select(quoted(benchmark, item_col).cast("string").alias("item"), quoted(benchmark, text_col).cast("string").alias("text"))
        .where("item IS NOT NULL AND text IS NOT NULL")
        .select("item", words.alias("words")).where(F.size("words") > 0)
        .select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))).alias("at"))
        .select("item", F.slice("words", F.col("at"), F.lit(width)).alias("parts"))
        .select("item", "parts", F.array_join("parts", " ").alias("window"))
        .groupBy("window").agg(F.first("parts").alias("parts"), F.array_sort(F.collect_set("item")).alias("items"))
    )


def hit_documents(slim: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """(d, h, hit, ids): for each contaminated (doc_id, hash of the text) its hit words and its items, of
    slim(doc_id long, text string not null)."""
    size = benchmark.agg(F.sum(F.octet_length(quoted(benchmark, item_text_col).cast("string"))).alias("b")).first()["b"] or 0
    small = (lambda df: F.broadcast(df)) if size <= broadcast_bytes else (lambda df: df)

    # Rarity: occurrences over all documents of the words that the benchmark has.
    windows = windows_of(benchmark, item_col, item_text_col, width)
    tokens = windows.select(F.explode("parts").alias("w")).select(F.lower("w").alias("key")).distinct()
    seen = slim.select(F.explode(F.split("text", SEPARATORS)).alias("w")).select(F.lower("w").alias("key"))
    counts = seen.join(small(tokens), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    placed = windows.select("window", "items", F.size("parts").alias("len"), F.posexplode("parts").alias("off", "w"))
    prefix = (
        placed.withColumn("key", F.lower("w")).join(counts, "key")
        .groupBy("window", "items", "len").agg(F.min(F.struct("n", "key", "off")).alias("rarest"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.col("len"))  # a window with a word that no document has cannot occur
        .select("window", "items", "len", F.col("rarest.key").alias("key"), F.col("rarest.off").alias("off"))
    )
    prefix = cut(prefix)  # a few rows per benchmark word; a broadcast then never waits for the counting

    at = slim.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.split("text", SEPARATORS).alias("words"))
    start = F.col("pos") - F.col("off")
    bounds = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = fold(F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ")) == F.col("window")
    if size <= broadcast_bytes:
        placed = at.select("doc_id", "hash", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "w")).withColumn("key", F.lower("w"))
        hits = placed.join(F.broadcast(prefix), "key").where(bounds).withColumn("start", start).where(same)
    else:
        placed = at.select("doc_id", "hash", F.size("words").alias("n"), F.posexplode("words").alias("pos", "w")).withColumn("key", F.lower("w")).drop("w")
        found = placed.join(prefix, "key").where(bounds).select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), start.alias("start"), "len", "window", "items").distinct()
        texts = at.select("doc_id", "hash", "words").dropDuplicates(["doc_id", "hash"])
        hits = texts.join(found, texts["doc_id"].eqNullSafe(found["d"]) & (texts["hash"] == found["h"])).where(same)

    # Words covered: intervals in order of their starts, each counted from where the ones before it end.
    spans = F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end"))))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")),
    )["n"]
    return (
        hits.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
        .select("d", "h", covered.cast("long").alias("hit"), "ids")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")).alias("text"))
    by_doc = hit_documents(slim, benchmark, **options)
    counted = slim.select("doc_id", F.xxhash64("text").alias("hash"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(by_doc, counted["doc_id"].eqNullSafe(by_doc["d"]) & (counted["hash"] == by_doc["h"]), "left").select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns as they are, without a word of a benchmark window."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")).alias("text"))
    by_doc = hit_documents(slim, benchmark, **options).select("d", "h")
    same = quoted(docs, id_col).cast("long").eqNullSafe(by_doc["d"]) & (F.xxhash64(F.coalesce(quoted(docs, text_col).cast("string"), F.lit(""))) == by_doc["h"])
    return docs.join(by_doc, same, "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_WORDS = _SPLIT.format(_FOLD.format("coalesce(text, '')"))

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS x
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw USING (n, x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""
