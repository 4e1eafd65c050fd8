"""Quality rules as a short-circuit cascade.

Each rule is a boolean column that says "reject". On a sample, every rule's rejection rate and its
time per row are measured, rules are ordered by rejection per cost, and one CASE expression tries
them in that order: a row stops at its first rejecting rule, so later rules are not evaluated
for it. A rule brings its own statistics along, as expressions over the text, its words and its lines, and they are computed
only where the rule is reached; the base counts, which every row shows, are computed before. The order affects speed
and the name of the rejecting rule alone; whether a row is kept does not depend on it.

A rule's time is the least of several runs over each sample row many times, less that of a rule that does nothing.

All text statistics are built-in functions over the whole text. The 5-word windows are compared
by 64-bit hash within one text.

Nulls and edges: a null or empty text has no words and every count 0, so base rules reject it;
null ids and repeated rows give one result row each; empty tables give empty results and the
written order of rules; other columns are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1_000  # rows (about) on which cost and rejection rate are estimated
TIMES, RUNS = 10, 3  # evaluations of a rule per sample row, and runs of which the fastest counts
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text, its words and its lines that hold one, and the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    split = base.withColumn("words", F.array_remove(F.split(F.translate("text", WHITE[1:], " " * len(WHITE[1:])), " "), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0))
    n = F.size("words")
    hashed = split.withColumn("_h", F.when(n >= 5, F.transform("words", lambda w: F.xxhash64(w))))
    gram = lambda k: F.xxhash64(*[F.get(F.col("_h"), k + j) for j in range(5)])
    grams = hashed.withColumn("_g", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), gram))).drop("_h")
    # positions of windows found twice or more: equal hashes are neighbours once sorted
    sorted_grams = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, k: F.struct(h.alias("h"), k.alias("k")))))
    marked = grams.withColumn("_s", sorted_grams).drop("_g")
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k).h == x.h, F.lit(False))  # noqa: E731  get() is null outside the array
    places = F.sort_array(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.k))
    placed = marked.withColumn("_p", F.when(F.col("_s").isNotNull(), places))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.when(k == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(F.col("_p"), k - 1)))), F.lit(0), lambda a, x: a + x)
    return placed.select(
        "doc_id",
        "text",
        "words",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        _without(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def default_rules() -> list[tuple[str, Column]]:
    """(name, rejects) of the rules after the base ones; thresholds leave ordinary prose far inside. The first three read base counts, the others compute what they need."""
    words, text = F.col("n_words"), F.col("text")
    return [
        ("symbols", 10 * F.col("n_symbols") > 3 * words),
        ("repeated_lines", (F.col("n_lines") >= 4) & (10 * F.col("n_dup_lines") > 4 * F.col("n_lines"))),
        ("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 25 * words)),
        ("capitals", 2 * _without(text, UPPER) > F.col("word_chars")),
        ("exclamation", 4 * _without(text, "!") > words),
        ("digits", 2 * _without(text, "0123456789") > F.col("word_chars")),
        ("bullets", (F.col("n_lines") >= 10) & (10 * F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^([-*\u2022]|\d+[.)])\s"))) > 9 * F.col("n_lines"))),
        ("one_word", (words >= 20) & (20 * F.size(F.array_distinct("words")) < words)),
    ]


def measure_rules(stats: DataFrame, rules: list[tuple[str, Column]], sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Of each rule on a sample: rejection rate, seconds a row (at least a nanosecond) and rejection per cost. `stats` must hold what the rules read."""
    total = stats.count()
    sample = (stats if total <= sample_rows else stats.sample(fraction=sample_rows / total, seed=11)).cache()
    try:
        rows = sample.count()
        again = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

        def run(rejects: Column) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(RUNS):
                began = time.perf_counter()
                hits = again.select(F.count_if(rejects)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        nothing, _ = run(F.col("_time") < 0)
        out = []
        for name, rejects in rules:
            spent, hits = run(rejects)
            cost = max(1e-9, (spent - nothing) / TIMES / max(1, rows))
            rate = hits / TIMES / max(1, rows)
            out.append({"rule": name, "rejection": rate, "cost": cost, "rank": rate / cost})
        return out
    finally:
        sample.unpersist()


def cascade(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that rejects, or null. A CASE stops at its first true branch."""
    out = F.lit(None).cast("string")
    for name, rejects in reversed(rules):
        out = F.when(rejects, F.lit(name)).otherwise(out)
    return out


def quality_cascade(docs: DataFrame, rules: list[tuple[str, Column]] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base_failed, rejected_by (null if kept) and kept for each row of `docs` (doc_id, text)."""
    rules = default_rules() if rules is None else rules
    total = docs.count()
    sample = docs if total <= sample_rows else docs.sample(fraction=sample_rows / total, seed=11)
    rank = {x["rule"]: x["rank"] for x in measure_rules(with_statistics(sample), rules, sample_rows)}
    ordered = sorted(rules, key=lambda r: -rank[r[0]])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = with_statistics(docs).withColumn("base_failed", failed)
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(ordered)))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("text", "words", "lines")


def op4_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, k, ws[k:k + 4] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM (SELECT doc_id, k, unnest(range(5)) AS j FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, text, ws, ls, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (len(ls) >= 4 AND 10 * n_dup_lines > 4 * len(ls))
  OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars OR 4 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
  OR 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars OR (len(ls) >= 10 AND 10 * len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^([-*\x{2022}]|[0-9]+[.)])\s'))) > 9 * len(ls))
  OR (n_words >= 20 AND 20 * len(list_distinct(ws)) < n_words)) AS kept FROM b
"""
