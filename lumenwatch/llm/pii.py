"""Personal data: fixed patterns, and terms that reveal a protected entity by their use over the corpus.

Base kinds (email, ip, card, phone) are found in every whole text; their values are the protected entities. The terms (words
of four letters or more) nearest to an entity are counted over the whole corpus. A term discloses an entity to the
share 1 - log p(e | t) / log p(e) of the entity's information content, where p(e | t) is the part of the term's
occurrences that stand near e and p(e) the part of all terms' occurrences that do. Terms with a share of ``disclosure``
or more and at least ``support`` different contexts of the entity are sensitive wherever they stand; they are
added as spans of kind ``term``. Base spans always stay. ``sanitise`` generalises both.

Defined cases: null text is empty; contexts that are equal word for word, as in copies of a document, support a term
once; repeated rows each get the full result; other columns are kept and not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.functions.columns import once
from lumenwatch.llm.common import fresh, row_key, table, total
from lumenwatch.llm.spans import Kind, count_kind, digits, luhn, outside, said, spans_of
from lumenwatch.session import settle

_OCTET = "(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))"
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda value, part: F.regexp_like(value, F.lit(rf"^{_OCTET}(\.{_OCTET}){{3}}$"))),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++",
        lambda value, part: F.when(F.length(digits(value)).between(13, 19), luhn(digits(value))).otherwise(False),
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda value, part: F.length(digits(value)).between(9, 15)),
)
KINDS = ["email", "ip", "card", "phone", "term"]
TERM = r"\p{L}{4,}+"
NEAR = 4  # terms on each side of an entity
REACH = 120  # code points in which they are looked for
SUPPORT = 3
DISCLOSURE = 0.9
BROADCAST_TERMS = 100_000


def _entity(span: Column) -> Column:
    return F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(F.concat(span["kind"], F.lit(":"), digits(span["value"])))


def _context(text: Column, span: Column) -> Column:
    """The nearest terms before and after a span; a word that the reach cuts is left out."""
    low = F.greatest(span["start"] - REACH, F.lit(0))
    before = F.substring(text, low + 1, span["start"] - low)
    before = F.when(low > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.substring(text, span["end"] + 1, F.lit(REACH))
    after = F.when(F.length(after) == REACH, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
    left, right = (F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0)) for x in (before, after))
    return F.concat(F.slice(left, -F.least(F.lit(NEAR), F.greatest(F.size(left), F.lit(1))), F.lit(NEAR)), F.slice(right, 1, NEAR))


def sensitive_terms(docs: DataFrame, entities: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """term, share: terms of the corpus that disclose an entity. ``entities`` has a row (entity, context) for each found span."""
    each = entities.select("entity", F.xxhash64("context").alias("where"), F.explode("context").alias("term"))
    pairs = each.groupBy("entity", "term", "where").count().groupBy("entity", "term").agg(
        F.sum("count").alias("near"), F.count("*").alias("contexts")
    )
    pairs = settle(pairs, "term-entities")
    of_entity = pairs.groupBy("entity").agg(F.sum("near").alias("of_entity"))
    candidates = settle(pairs.where(F.col("contexts") >= support).join(of_entity, "entity"), "term-candidates")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
    uses = settle(words.groupBy("term").agg(F.count("*").alias("uses")), "term-uses")
    # One number over the whole corpus.
    every = uses.agg(F.coalesce(F.sum("uses"), F.lit(0)).cast("double")).first()[0]
    log_e = F.log(F.col("of_entity") / F.lit(max(every, 1.0)))
    log_e_t = F.log(F.least(F.col("near") / F.col("uses"), F.lit(1.0)))
    share = F.when(log_e < 0, 1 - log_e_t / log_e).otherwise(F.lit(0.0))
    judged = candidates.join(uses, "term").withColumn("share", share).where(F.col("share") >= disclosure)
    return settle(judged.groupBy("term").agg(F.max("share").alias("share")), "sensitive-terms")


def _term_hits(docs: DataFrame, terms: DataFrame, key: Column, text: str) -> DataFrame:
    """key, spans of kind term: every place where a sensitive term stands."""
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    placed = docs.select(
        key.alias("key"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words"), F.split(F.col(text), TERM, -1).alias("gaps")
    )
    words = placed.select("key", "words", "gaps", F.posexplode("words").alias("at", "word")).withColumn("term", F.lower("word"))
    hits = words.join(F.broadcast(terms.select("term")) if small else terms.select("term"), "term")
    start = total(F.transform(F.slice("words", F.lit(1), F.col("at")), F.length)) + total(F.transform(F.slice("gaps", F.lit(1), F.col("at") + 1), F.length))
    hits = hits.select("key", start.alias("start"), "word")
    return hits.groupBy("key").agg(
        F.collect_set(F.struct(F.lit("term").alias("kind"), "start", (F.col("start") + F.length("word")).alias("end"), F.col("word").alias("value"))).alias("terms")
    )


def find_pii(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE, into: str = "pii"
) -> DataFrame:
    """The input with one struct column: ``base`` spans and ``terms`` spans outside them."""
    key, base, found = (fresh(docs, n) for n in ("row_key", "base_spans", "found_terms"))
    scanned = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"))
    scanned = once(scanned, "base", spans_of(F.col("text"), BASE)).withColumn("key", row_key(F.col("id"), F.col("text")))
    scanned = scanned.where(F.size("base") > 0).withColumn("seen", F.transform("base", lambda s: F.struct(_entity(s).alias("entity"), _context(F.col("text"), s).alias("context"))))
    scanned = settle(scanned.select("key", "base", "seen"), "personal-data")
    terms = sensitive_terms(docs.select(F.col(text).alias("text")), scanned.select(F.explode("seen").alias("s")).select("s.*"), "text", support, disclosure)
    hits = _term_hits(docs, terms, row_key(F.col(doc_id), F.col(text)), text)
    hits = settle(hits, "term-hits")
    base_of = scanned.select(F.col("key").alias(key), F.col("base").alias(base)).dropDuplicates([key])
    keyed = docs.withColumn(key, row_key(F.col(doc_id), F.col(text))).join(base_of, key, "left")
    keyed = keyed.join(hits.select(F.col("key").alias(key), F.col("terms").alias(found)), key, "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    base_spans, term_spans = F.coalesce(F.col(base), none), F.coalesce(F.col(found), none)
    return keyed.withColumn(into, F.struct(base_spans.alias("base"), outside(term_spans, base_spans).alias("terms"))).drop(key, base, found)


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The input's rows with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    into = fresh(docs, "pii")
    out = find_pii(docs, text, doc_id, support, disclosure, into)
    every = F.array_sort(F.transform(F.concat(F.col(into)["base"], F.col(into)["terms"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    apart = F.aggregate(every, none, lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), a).otherwise(F.concat(a, F.array(s))))
    cut = fresh(out, "cut")
    out = out.withColumn(cut, apart)
    masked = F.col(cut)
    pieces = F.transform(
        masked,
        lambda s, i: F.concat(
            F.substring(F.col(text), F.coalesce(F.get(masked, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(masked, i - 1)["end"], F.lit(0))),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        ),
    )
    tail = F.substring(F.col(text), F.get(masked, F.size(masked) - 1)["end"] + 1, F.length(text))
    return out.withColumn(text, F.when(F.size(masked) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))).select(docs.columns)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pii")
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *(count_kind(p["base"], k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(said(p["base"], KINDS, by_kind=True), 256).alias("base_sha256"),
        said(F.concat(p["base"], p["terms"]), KINDS, by_kind=True).alias("spans"),
        F.size(p["terms"]).cast("long").alias("n_terms"),
    )


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLES: dict[str, str] = {}
