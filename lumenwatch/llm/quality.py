"""Quality rules: a threshold table compiled into one projection of built-in expressions.

``measures`` adds counts and ratios of every whole text, ``RULES`` says which ranges a kept document must lie in, and
``verdict`` turns the table into one boolean expression. No step shuffles; a row's result depends on its text alone.

Defined cases: null or blank text has no words, all counts 0, and fails; an equal line or window counts each time it
comes back; columns of the input, whatever their names, are neither read nor changed. Three-word windows are compared
by 64-bit hashes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.functions.columns import once
from lumenwatch.llm.common import fresh, let, spaced_words, table

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it not of on or that the this to was what with "
    "au aux ce dans des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "auch auf das dem den der die ein eine ist im mit nicht sich sie und von wie zu "
    "al como con de del el es las lo los mi por se su y"
).split()


class Rule(NamedTuple):
    """Keep documents whose measure lies in [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("enough_words", "n_words", 50, None),
    Rule("few_repeated_windows", "repeat_ratio", None, 0.5),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("few_symbols", "symbol_ratio", None, 0.1),
    Rule("has_stop_words", "stop_ratio", 0.02, None),
    Rule("few_equal_lines", "dup_line_ratio", None, 0.4),
)
BASE = ("enough_words", "few_repeated_windows")


def _counts(words: Column, text: Column) -> dict[str, Column]:
    n = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    spoken = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(spoken))).cast("long"),
        "lines": lines,
        "windows": F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    }


def _repeated(windows: Column) -> Column:
    """Words inside windows that occur more than once: starts of such windows, sorted, cover 3 words each."""
    in_order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(order: Column) -> Column:
        return F.transform(
            order,
            lambda x, k: F.when((F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]), x["i"]),
        )

    return F.aggregate(
        F.sort_array(F.filter(let(in_order, starts), lambda i: i.isNotNull())),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("covered")),
        lambda a, i: F.struct(i.alias("last"), (a["covered"] + F.least(F.lit(3), i - a["last"])).alias("covered")),
        lambda a: a["covered"],
    )


def measures(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """The input with one struct column of counts and ratios, named ``into``."""
    words, counts, windows = (fresh(docs, n) for n in ("words", "counts", "windows"))
    given = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(words, spaced_words(F.col(text)))
    parts = _counts(F.col(words), given)
    out = out.withColumns({counts: F.struct(*(c.alias(n) for n, c in parts.items() if n != "windows")), windows: parts["windows"]})
    seen = F.col(windows)
    repeated = F.when(F.size(F.array_distinct(seen)) == F.size(seen), F.lit(0)).otherwise(_repeated(seen))
    out = out.withColumn(windows, repeated.cast("long"))

    c = F.col(counts)
    n_lines = F.size(c["lines"])
    dup = (n_lines - F.size(F.array_distinct(c["lines"]))).cast("long")
    some_words = F.greatest(c["n_words"], F.lit(1))
    measured = F.struct(
        *(c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_stop_words")),
        dup.alias("n_dup_lines"),
        F.col(windows).alias("n_repeat_words"),
        (F.col(windows) / some_words).alias("repeat_ratio"),
        (c["word_chars"] / some_words).alias("mean_word_chars"),
        (c["n_symbols"] / some_words).alias("symbol_ratio"),
        (c["n_stop_words"] / some_words).alias("stop_ratio"),
        (dup / F.greatest(n_lines, F.lit(1))).alias("dup_line_ratio"),
    )
    return once(out, into, measured).drop(words, counts, windows)


def failed(measured: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a rule of the table is broken."""
    broken = F.lit(False)
    for rule in rules:
        value = measured[rule.measure]
        if rule.low is not None:
            broken = broken | (value < rule.low)
        if rule.high is not None:
            broken = broken | (value > rule.high)
    return broken


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of the input that break no rule, with the input's own columns."""
    into = fresh(docs, "measures")
    return measures(docs, text, into).where(~failed(F.col(into), rules)).drop(into)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    base = tuple(r for r in RULES if r.name in BASE)
    return measures(table(spark, sf_dir, "documents").select("doc_id", "text"), into="m").select(
        "doc_id",
        *(m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed(m, base).alias("base_failed"),
        (~failed(m)).alias("kept"),
        m["n_stop_words"].alias("n_stop_words"),
    )


def _oracle() -> str:
    spoken = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         row_number() OVER () AS rid
  FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: x IN ({spoken}))) AS n_stop_words
  FROM w LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, n_stop_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR n_repeat_words / n_words > 0.5 OR word_chars / n_words < 2.0 OR word_chars / n_words > 12.0
            OR n_symbols / n_words > 0.1 OR n_stop_words / n_words < 0.02
            OR (len(ls) - len(list_distinct(ls))) / len(ls) > 0.4) AS kept
FROM m
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
