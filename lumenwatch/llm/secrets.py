"""Secret scans with corpus-wide ownership frequency.

Base kinds are found in every whole text. The method looks at candidates over the whole corpus: the values of base
matches and long mixed tokens (kind ``key``). Their hashes are counted by distinct repositories and owners, folded
before each shuffle. A value that ``owners`` or more owners hold is a widely copied example; a value of fewer owners that is no
placeholder looks live. Mixed tokens that look live are added as spans; base spans always stay.

Defined cases: null text is empty; a null owner or repository counts as one unnamed; rows that repeat are counted once
for each repository and owner; other columns of the input are kept and not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.functions.columns import once
from lumenwatch.llm.common import fresh, row_key, table
from lumenwatch.llm.spans import Kind, count_kind, outside, replaced, said, spans_of
from lumenwatch.session import settle

BASE = (
    Kind(
        "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""",
        lambda value, part: F.length(part) >= 6, 1,
    ),
    Kind("access", "AKIA[A-Z0-9]{16,}+"),
    Kind("hex", "[0-9a-f]{24,}+"),
)
#: Long tokens; those with digits and letters of both cases are candidates.
KEY = Kind(
    "key", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+",
    lambda value, part: F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Z]")) & F.regexp_like(value, F.lit("[a-z]")),
)
KINDS = ["assign", "access", "hex", "key"]
OWNERS = 3
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000000|1234567|abcdef"


def secret_value(span: Column) -> Column:
    """What is hashed: of an assignment its value, else the match."""
    value = F.regexp_extract(span["value"], BASE[0].pattern, 1)
    return F.when(span["kind"] == "assign", value).otherwise(span["value"])


def ownership(candidates: DataFrame, owners: int = OWNERS) -> DataFrame:
    """hash, n_repos, n_owners, live: over candidate rows (hash, value, repo, owner)."""
    pairs = candidates.groupBy("hash", "repo", "owner").agg(F.first("value").alias("value"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.first("value").alias("value"))
    seen = by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.first("value").alias("value"))
    live = (F.col("n_owners") < owners) & ~F.regexp_like("value", F.lit(PLACEHOLDER))
    return seen.select("hash", "n_repos", "n_owners", live.alias("live"))


def find_secrets(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repo: str | None = None,
    owners: int = OWNERS, into: str = "secrets",
) -> DataFrame:
    """The input with one struct column: base spans, all spans, live spans (sorted, none overlapping), and counts.

    ``repo`` names the column of repositories; without it each document is one.
    """
    key, found = (fresh(docs, n) for n in ("row_key", "found_spans"))
    name = F.col(doc_id) if repo is None else F.col(repo)
    scanned = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("words"), F.col(owner).cast("string").alias("owner"), name.cast("string").alias("repo")
    )
    scanned = once(scanned, "found", F.struct(spans_of(F.col("words"), BASE).alias("base"), spans_of(F.col("words"), (KEY,)).alias("more")))
    scanned = scanned.where((F.size("found.base") > 0) | (F.size("found.more") > 0)).select(
        row_key(F.col("id"), F.col("words")).alias("key"), "owner", "repo", "found.*"
    )
    scanned = settle(scanned.withColumn("more", outside(F.col("more"), F.col("base"))), "secret-candidates")
    each = scanned.select("key", "owner", "repo", F.explode(F.concat("base", "more")).alias("span"))
    each = each.withColumn("value", secret_value(F.col("span"))).withColumn("hash", F.sha2("value", 256))
    verdicts = settle(ownership(each.select("hash", "value", "repo", "owner"), owners), "secret-owners")
    judged = each.select("key", "span", "hash").join(verdicts, "hash").groupBy("key").agg(
        F.collect_set(F.struct(F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.kind").alias("kind"), "live", "n_owners")).alias("all")
    )

    def parts(where) -> Column:
        picked = F.filter(F.col("all"), where)
        return F.array_sort(F.transform(picked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    judged = judged.select(
        "key",
        F.struct(
            parts(lambda s: s["kind"] != "key").alias("base"),
            parts(lambda s: (s["kind"] != "key") | s["live"]).alias("spans"),
            _merged(parts(lambda s: s["live"])).alias("live"),
            F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        ).alias("found"),
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    keyed = docs.withColumn(key, row_key(F.col(doc_id), F.col(text)))
    joined = keyed.join(judged.select(F.col("key").alias(key), F.col("found").alias(found)), key, "left")
    got = F.col(found)
    return joined.withColumn(
        into,
        F.struct(
            *(F.coalesce(got[n], none).alias(n) for n in ("base", "spans", "live")), F.coalesce(got["n_copied"], F.lit(0)).cast("long").alias("n_copied")
        ),
    ).drop(key, found)


def _merged(spans: Column) -> Column:
    """Overlapping spans of a sorted array as one: a span that starts inside an earlier one lengthens it."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(
            F.concat(out, F.array(s))
        )

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"), add)


def redact_secrets(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", mark: str = "[SECRET]", length: str | None = "n_chars"
) -> DataFrame:
    """The input's rows with each secret that looks live replaced by a mark; a column of text lengths follows."""
    into, changed = fresh(docs, "secrets"), fresh(docs, "changed_text")
    out = find_secrets(docs, text, doc_id, owner, into=into)
    out = out.withColumn(changed, replaced(F.col(text), F.col(into)["live"], mark))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.size(F.col(into)["live"]) > 0, F.length(changed).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.withColumn(text, F.col(changed)).select(docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    s = F.col("secrets")
    return find_secrets(docs).select(
        "doc_id",
        *(count_kind(s["base"], k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(said(s["base"], KINDS, by_kind=False), 256).alias("base_sha256"),
        said(s["spans"], KINDS, by_kind=False).alias("spans"),
        F.size(s["live"]).cast("long").alias("n_live"),
        s["n_copied"].alias("n_copied"),
    )


QUERIES = {"op10_secret_scans": op10_secret_scans}
ORACLES: dict[str, str] = {}
