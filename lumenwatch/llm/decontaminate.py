"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned for in whole documents.

A window is 10 consecutive words of an item (an item with fewer words is one shorter window). Every document position is
probed by the hash of the words there; equal hashes are verified word by word. Windows that the same items share are
named by one item set, so a passage of many items costs one hit a position and not one for each item.

Defined cases: null text has no words; an item without words has no window; a null ``item_id`` stands as an empty id;
items that repeat an id count once; repeated documents each get the full result. Up to ``BROADCAST_WINDOWS`` windows are
sent to every task, more are joined by a shuffle on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm.common import fresh, lowered, row_key, table
from lumenwatch.session import settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_WINDOWS = 200_000


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(length)))


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (length, words, set_id) and the item sets (set_id, items) they belong to."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), plain_words(F.col(text)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1))
    pieces = items.select("item", "length", "words", starts.alias("at")).select(
        "item", "length", F.slice("words", F.col("at"), F.col("length")).alias("words")
    )
    held = pieces.groupBy("length", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = settle(held.withColumn("set_id", F.md5(F.to_json("items"))), "benchmark-windows")
    return held.select("length", "words", "set_id"), held.groupBy("set_id").agg(F.first("items").alias("items"))


def _probes(docs: DataFrame, key: Column, text: str, lengths: list[int]) -> DataFrame:
    """Every document position with each length of a window that fits there: key, words, at, length, h. One scan for all lengths."""
    placed = docs.select(key.alias("key"), plain_words(F.col(text)).alias("words"))
    placed = placed.select("key", "words", F.posexplode("words").alias("at", "word"))
    fits = [F.struct(F.lit(n).alias("length"), F.when(F.col("at") + n <= F.size("words"), _window_hash(F.col("words"), F.col("at"), n)).alias("h")) for n in lengths]
    probe = F.explode(F.array(*fits)) if len(fits) > 1 else fits[0]
    return placed.select("key", "words", "at", probe.alias("probe")).select("key", "words", "at", "probe.length", "probe.h").where("h IS NOT NULL")


def window_hits(docs: DataFrame, windows: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """One row per document position at which a window starts: key, at, length, set_id.

    Where the windows are too many to broadcast, positions travel as numbers: those whose hash stands in the set are found first,
    and only the words at these are read again, from the documents that have any, and verified.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect()) or [WINDOW]  # at most as many as a window has words
    hashed = F.coalesce(*(F.when(F.col("length") == n, _window_hash(F.col("words"), F.lit(0), n)) for n in lengths))
    there = windows.select(F.col("length").alias("n"), hashed.alias("h"), F.col("words").alias("wanted"), "set_id")
    probes = _probes(docs, key, text, lengths)
    if windows.count() <= BROADCAST_WINDOWS:
        hits = probes.join(F.broadcast(there), "h").where(F.slice("words", F.col("at") + 1, F.col("length")) == F.col("wanted"))
        return hits.select("key", "at", "length", "set_id")
    found = probes.select("key", "at", "length", "h").join(there.select("h").distinct(), "h", "left_semi")
    found = settle(found.groupBy("key").agg(F.collect_set(F.struct("at", "length", "h")).alias("places")), "window-places")
    read = docs.select(key.alias("key"), plain_words(F.col(text)).alias("words")).join(found, "key")
    slices = F.transform("places", lambda p: F.struct(p["at"], p["length"], p["h"], F.slice("words", p["at"] + 1, p["length"]).alias("held")))
    read = read.select("key", F.explode(slices).alias("p")).select("key", "p.at", "p.length", "p.h", "p.held")
    return read.join(there, "h").where("held = wanted").select("key", "at", "length", "set_id")


def _covered(starts: Column) -> Column:
    """Words in the union of the spans [at, at + length), given sorted structs."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["length"]).alias("end"),
            (a["covered"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(a["end"], s["at"]))).alias("covered"),
        ),
        lambda a: a["covered"],
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "hits", window: int = WINDOW
) -> DataFrame:
    """The input with one struct column ``into``: n_words, n_hit words, item ids, and the hit spans (word index, length)."""
    windows, sets = benchmark_windows(benchmark, window=window)
    hits = window_hits(docs, windows, row_key(F.col(doc_id), F.col(text)), text)
    by_doc = hits.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"), F.collect_set("set_id").alias("sets")
    )
    by_doc = settle(by_doc.withColumn("together", F.md5(F.array_join(F.array_sort("sets"), ","))), "window-hits")
    # Documents with the same sets have the same items: each combination is worked out once.
    combined = by_doc.groupBy("together").agg(F.first("sets").alias("sets")).select("together", F.explode("sets").alias("set_id")).join(sets, "set_id")
    named = combined.select("together", F.explode("items").alias("item")).groupBy("together").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = by_doc.select("key", "spans", "together").join(named, "together").select(
        F.col("key"), F.struct(_covered(F.col("spans")).cast("long").alias("n_hit"), "items", "spans").alias(into)
    )
    key, count, found = (fresh(docs, n) for n in ("row_key", "word_count", "found_hits"))
    keyed = docs.withColumns({key: row_key(F.col(doc_id), F.col(text)), count: F.size(plain_words(F.col(text))).cast("long")})
    joined = keyed.join(result.select(F.col("key").alias(key), F.col(into).alias(found)), key, "left")
    return joined.withColumn(
        into,
        F.struct(
            F.col(count).alias("n_words"),
            F.coalesce(F.col(found)["n_hit"], F.lit(0)).alias("n_hit"),
            F.coalesce(F.col(found)["items"], F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.col(found)["spans"], F.array().cast("array<struct<at:int,length:int>>")).alias("spans"),
        ),
    ).drop(key, count, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the input in which no benchmark window occurs, with the input's own columns."""
    windows, _ = benchmark_windows(benchmark)
    key = fresh(docs, "row_key")
    hit = window_hits(docs, windows, row_key(F.col(doc_id), F.col(text)), text).select(F.col("key").alias(key)).distinct()
    hit = settle(hit, "contaminated")
    return docs.withColumn(key, row_key(F.col(doc_id), F.col(text))).join(hit, key, "left_anti").select(docs.columns)


def remove_spans(text: Column, spans: Column) -> Column:
    """The lower-cased words of a text without the hit spans, joined by blanks."""
    return F.array_join(
        F.filter(plain_words(text), lambda w, i: ~F.exists(spans, lambda s: (i >= s["at"]) & (i < s["at"] + s["length"]))), " "
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        (h["n_hit"] > 0).alias("contaminated"),
    )


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT rid, ws, i, n FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM w) WHERE i + n - 1 <= len(ws)),
h AS (SELECT p.rid, p.i, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND array_to_string(p.ws[p.i:p.i + p.n - 1], ' ') = w.g),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": ORACLE}
