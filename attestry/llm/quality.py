"""Quality rules as a short-circuit cascade.

Features are counted over the whole text in one row, with built-in functions only. A rule rejects a document by its
features or text. :func:`plan_cascade` measures on a random sample what each rule costs a row, as the time of a job that asks it
``REPEATS`` times a row less that of a job that asks nothing, and counts what it rejects there. It orders the rules by rejections
per second; :func:`quality_cascade` asks them in that order and stops at the first that rejects, and asks none of them of a row that
the base rules reject. The order changes the cost, never the verdict; ``rejected_by`` names the first rule in that order.

Edge cases: a null or empty text has no words, so all counts are 0; nulls elsewhere are left alone; an empty table
gives no rows; repeated rows get equal verdicts. Columns of the input that have a feature's name are replaced, all others stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, table

WINDOW = 8
#: Rows that the rules are measured on, about, and how often each rule is asked of each.
SAMPLE_ROWS, REPEATS = 400, 40
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: the generator keeps the optimizer from copying the expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def add_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long)."""
    df = docs.drop(*FEATURES)
    own, (t_, a_, h_, s_, p_) = df.columns, (fresh(df, f"_{c}_of_text") for c in ("text", "words", "windows", "sorted", "places"))
    df = df.withColumn(t_, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = F.filter(F.split(t_, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t_, "\n"), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    df = _once(df, a_, F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("w"), lines.alias("lines")))
    n = F.size(f"{a_}.w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(f"{a_}.w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", n.cast("long").alias("n_words"), F.size(f"{a_}.lines").cast("long").alias("n_lines"), (F.size(f"{a_}.lines") - F.size(F.array_distinct(f"{a_}.lines"))).cast("long").alias("n_dup_lines"))
    df = _once(df, h_, windows).drop(a_)
    # only texts with some window twice are sorted: equal windows become neighbours, and their places give the words that they cover
    twice = F.size(F.array_distinct(h_)) < F.size(h_)
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    df = _once(df, s_, F.when(twice, F.array_sort(F.transform(h_, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(empty)).drop(h_)
    same = lambda x, i: (F.get(s_, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s_, i + 1)["h"].eqNullSafe(x["h"]))
    df = _once(df, p_, F.array_sort(F.transform(F.filter(s_, same), lambda x: x["p"]))).drop(s_)
    covered = F.aggregate(
        p_, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"],
    )
    return df.select(
        *own, "n_words", "n_lines", "n_dup_lines",
        F.length(F.translate(t_, _WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t_) - F.length(F.translate(t_, SYMBOLS, ""))).cast("long").alias("n_symbols"), covered.cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """reject(text column) is true where the rule rejects; it may use the features."""

    name: str
    reject: Callable[[Column], Column]


@dataclass(frozen=True)
class Estimate:
    name: str
    #: For one row.
    seconds: float
    rejected: int


def _share(pattern: str, text: Column) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


#: The limits are far from what prose, tables and code reach: documents that are merely unusual stay.
RULES = (
    Rule("symbols", lambda t: F.col("n_symbols") > F.col("n_words")),
    Rule("exclamations", lambda t: F.length(t) - F.length(F.translate(t, "!?", "")) > F.col("n_words")),
    Rule("shouting", lambda t: 2 * _share(r"[^\p{Lu}]+", t) > F.col("word_chars") + F.lit(10)),
    Rule("repeated_lines", lambda t: 10 * F.col("n_dup_lines") > 7 * F.col("n_lines")),
    Rule("word_length", lambda t: (F.col("word_chars") > 30 * F.col("n_words")) | (2 * F.col("word_chars") < 3 * F.col("n_words"))),
)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[Estimate]:
    """The rules by rejections per second, from about sample_rows rows of the whole table. Only the order depends on the sample."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.count()
    some = docs.select(text_col).sample(min(1.0, sample_rows / max(rows, 1)), seed=7)
    sample = add_features(some, text_col).coalesce(1).persist()
    try:
        n = max(1, sample.count())
        often = sample.withColumn(fresh(sample, "_again"), F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def timed(asked: Column) -> tuple[float, int]:
            best = float("inf")
            for _ in range(2):  # the first also compiles
                start = time.perf_counter()
                hits = often.select(F.count_if(asked).alias("n")).first()["n"]
                best = min(best, time.perf_counter() - start)
            return best, hits

        # what it costs to hand the text to a rule at all
        idle = timed(F.length(text) + F.col("n_words") < 0)[0]
        found = []
        for rule in rules:
            spent, hits = timed((F.length(text) < 0) | rule.reject(text))
            found.append(Estimate(rule.name, max(spent - idle, 1e-6 * repeats) / (n * repeats), hits // repeats))
    finally:
        sample.unpersist()
    # one more rejection than counted: a rule that rejects nothing in the sample may reject elsewhere
    return sorted(found, key=lambda e: (-(e.rejected + 1) / e.seconds, e.name))


def quality_cascade(features: DataFrame, order: list[str], rules: tuple[Rule, ...] = RULES, text_col: str = "text", unless: Column | None = None) -> DataFrame:
    """features (see add_features) with rejected_by: the first rule, in this order, that rejects; null if none, or where
    unless is true: no rule is asked there."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by = {r.name: r for r in rules}
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(by[name].reject(text), name).otherwise(verdict)
    return features.withColumn("rejected_by", verdict if unless is None else F.when(~unless, verdict))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, base verdict and the cascade's verdict for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [e.name for e in plan_cascade(docs)]
    q = quality_cascade(add_features(docs), order, unless=base_failed())
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.col("rejected_by").isNull()).alias("kept"))


ORACLE_OP3 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
x AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM b WHERE len(w) >= 8),
h AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS g FROM x),
d AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM h) WHERE n > 1),
c AS (SELECT r, sum(least(8, gap)) AS n FROM (SELECT r, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 8) AS gap FROM d) GROUP BY r),
f AS (
  SELECT b.r, doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN c ON b.r = c.r
), g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > n_words OR length(text) - length(regexp_replace(text, '[!?]', '', 'g')) > n_words
    OR 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > word_chars + 10 OR 10 * n_dup_lines > 7 * n_lines
    OR word_chars > 30 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM g
"""
