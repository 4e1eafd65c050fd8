"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to target marginals: in turn each
dimension's cells are scaled so that their sum per value meets the target, until all marginals
hold. A document is then kept with its cell's calibrated probability: the raked weight over the
available weight, times the budget.

No cell can give more tokens than it has. Targets above what a value has are lowered to that, and the other
values of the dimension take the rest in proportion (`feasible_shares`); in the raking, a cell's weight never rises above its
bound, and the next sweeps raise the cells that still have room, so what one cell can't give comes from
its neighbours and the marginals are still met. `marginals` reports wanted, feasible and reached shares. The draw is a fixed hash of the
document's id, so it does not depend on partitioning or retries.

Everything is DataFrame functions. Counting is one aggregation with map-side combining, the raking
runs on the table of cells (its rows follow the number of distinct values, not of documents), and
documents meet their cell's probability by a join that adaptive execution can split.

Targets: a value's share of the tokens to the power `alpha`, renormalised, unless a table of
shares is given. Values are compared as text; null is a value of its own.

Nulls and edges: null text counts 0 tokens; null source, language and topic form their own values;
rows with a null id are drawn by the text 'null'; repeated rows are kept or dropped together; an
empty table gives an empty result; other columns pass through unless they begin with "_mix_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.staging import drop, stage

ALPHA = 0.7
SWEEPS = 24  # over all dimensions
FILLS = 6  # rounds in which infeasible shares are handed on
BUDGET = 0.6  # of all tokens
DIMENSIONS = ("source", "lang", "topic")
_EMPTY = "\u0000null"  # stands for null in keys


def token_count(text: Column) -> Column:
    """Words: white-space separated runs."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def topic_of(text: Column) -> Column:
    """A form-based topic: table, contact, code or secret-like, long, short or other prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    return F.when(t.contains(" | "), "table").when(t.contains("@") | t.contains("+1 ("), "contact").when(n >= 4000, "long").when(n < 800, "short").otherwise("prose")


def draw(key: Column) -> Column:
    """A number in [0, 1) from the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def cells(docs: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """(dimension columns, tokens) with nulls named."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit(_EMPTY)).alias(d) for d in dimensions]
    return docs.groupBy(*keys).agg(F.sum("_mix_tokens").cast("double").alias("tokens"))


def feasible_shares(table: DataFrame, dimension: str, budget: float, targets: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """(value, available, wanted, share) of a dimension of `table` (tokens above 0): share is wanted, or at most what the value's tokens allow of the budget.

    What lowered values leave goes to the others in proportion, FILLS times. `available` and shares count tokens by the sum of all.
    """
    sums = table.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("_mix_t"))
    if targets is None:
        sums = sums.withColumn("_mix_p", F.pow("_mix_t", F.lit(alpha)))
    else:
        given = targets.select(F.coalesce(F.col("value").cast("string"), F.lit(_EMPTY)).alias("value"), F.col("share").cast("double").alias("_mix_p"))
        sums = sums.join(given, "value", "left").withColumn("_mix_p", F.coalesce("_mix_p", F.lit(0.0)))
    every = Window.partitionBy()  # a row a value: the dimension's own few rows
    total = lambda c: F.sum(c).over(every)
    out = sums.select("value", (F.col("_mix_t") / total("_mix_t")).alias("available"), F.when(total("_mix_p") > 0, F.col("_mix_p") / total("_mix_p")).otherwise(0.0).alias("wanted"))
    bound = F.col("available") / F.lit(budget)
    out = out.withColumn("share", F.least(F.col("wanted"), bound))
    for _ in range(FILLS):
        full = F.col("share") >= bound
        rest = total(F.when(full, F.lit(0.0)).otherwise(F.col("share")))
        grow = F.when(rest > 0, (F.lit(1.0) - total(F.when(full, F.col("share")).otherwise(F.lit(0.0)))) / rest).otherwise(F.lit(1.0))
        out = out.withColumn("share", F.least(bound, F.when(full, F.col("share")).otherwise(F.col("share") * grow)))
    return out


def rake(table: DataFrame, dimensions=DIMENSIONS, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, sweeps: int = SWEEPS, budget: float = BUDGET, tolerance: float = 1e-6) -> DataFrame:
    """`table` of cells with weight, in shares of the budget: raked so that each dimension's sums meet its feasible shares, no weight above what the cell's tokens allow.

    targets: for a dimension, a table (value, share); values without a row get 0. Ends after `sweeps` sweeps, or, looking every third
    one, once all sums are within `tolerance` of their share (0: never before).
    """
    table = table.filter("tokens > 0")
    for d in dimensions:
        shares = feasible_shares(table, d, budget, (targets or {}).get(d), alpha)
        table = table.join(shares.select(F.col("value").alias(d), F.col("share").alias(f"_mix_{d}")), d)
    everything = table.agg(F.sum("tokens").alias("_mix_all"))
    bound = F.col("tokens") / (F.lit(budget) * F.col("_mix_all"))
    table = stage(table.join(F.broadcast(everything)).withColumn("_mix_bound", bound).withColumn("weight", F.col("tokens")), "mix-cells")  # the broadcast side is one row
    for sweep in range(sweeps):
        after = table
        for d in dimensions:
            over = F.sum("weight").over(Window.partitionBy(d))
            after = after.withColumn("weight", F.when(over > 0, F.least(F.col("_mix_bound"), F.col("weight") * F.col(f"_mix_{d}") / over)).otherwise(F.lit(0.0)))
        if sweep % 3 == 2 or sweep == sweeps - 1:
            after = stage(after, "mix-cells")
            if tolerance > 0 and _misfit(after, dimensions) <= tolerance:
                table = after
                break
        table = after
    return table.select(*dimensions, "tokens", "weight")


def _misfit(cells_: DataFrame, dimensions) -> float:
    """The largest relative distance of a value's weight from its share."""
    worst = 0.0
    for d in dimensions:
        sums = cells_.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"_mix_{d}").alias("s")).filter("s > 0")
        worst = max(worst, sums.agg(F.max(F.abs(F.col("w") / F.col("s") - 1))).first()[0] or 0.0)
    return worst


def marginals(raked: DataFrame, dimensions=DIMENSIONS, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, budget: float = BUDGET) -> DataFrame:
    """(dimension, value, wanted, feasible, reached) shares of the tokens drawn; wanted above feasible marks a target that the tokens can't meet."""
    out = None
    for d in dimensions:
        shares = feasible_shares(raked, d, budget, (targets or {}).get(d), alpha)
        reached = raked.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("reached"))
        part = shares.join(reached, "value").select(F.lit(d).alias("dimension"), "value", "wanted", F.col("share").alias("feasible"), "reached")
        out = part if out is None else out.union(part)
    return out


def keep_probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with p: the tokens that the weight asks for over the tokens there are. Raked weights keep it at 1 or below; `least` only takes off rounding."""
    total = raked.agg(F.sum("tokens").alias("_mix_total"))
    p = F.lit(budget) * F.col("_mix_total") * F.col("weight") / F.col("tokens")
    return raked.join(F.broadcast(total)).withColumn("p", F.least(F.lit(1.0), p)).drop("_mix_total")  # one row


def mix_documents(docs: DataFrame, budget: float = BUDGET, alpha: float = ALPHA, key: str = "doc_id", topic: Column | None = None, targets: dict[str, DataFrame] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """The documents drawn, with their columns and _mix_p, _mix_tokens and _mix_topic. targets: tables (value, share) by dimension."""
    marked = docs.withColumn("_mix_tokens", token_count(F.col("text"))).withColumn("_mix_topic", topic_of(F.col("text")) if topic is None else topic)
    counted = stage(cells(marked.select("source", "lang", F.col("_mix_topic").alias("topic"), "_mix_tokens")), "mix-counts")
    p = stage(keep_probabilities(rake(counted, targets=targets, alpha=alpha, budget=budget, tolerance=tolerance), budget), "mix-p")
    drop(counted)
    named = p.select(F.col("source").alias("_mix_s"), F.col("lang").alias("_mix_l"), F.col("topic").alias("_mix_t"), F.col("p").alias("_mix_p"))
    same = (F.coalesce(F.col("source").cast("string"), F.lit(_EMPTY)) == F.col("_mix_s")) & (F.coalesce(F.col("lang").cast("string"), F.lit(_EMPTY)) == F.col("_mix_l")) & (F.col("_mix_topic") == F.col("_mix_t"))
    joined = marked.join(named, same, "left").drop("_mix_s", "_mix_l", "_mix_t")
    return joined.filter(draw(F.col(key)) < F.coalesce("_mix_p", F.lit(0.0)))


def op9_ipf_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    kept = mix_documents(docs, tolerance=0)  # all sweeps, as the SQL says it
    return kept.select("doc_id", "source", "lang", F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_tokens"), F.round("_mix_p", 6).alias("p"))


def _sql() -> str:
    dims = ("source", "lang", "topic")
    parts = [
        r"""d AS (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact' WHEN length(text) >= 4000 THEN 'long' WHEN length(coalesce(text, '')) < 800 THEN 'short' ELSE 'prose' END AS topic FROM documents)""",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for k in dims:
        parts.append(f"a_{k} AS (SELECT {k}, sum(tokens) / sum(sum(tokens)) OVER () / {BUDGET} AS bound, pow(sum(tokens), {ALPHA}) / sum(pow(sum(tokens), {ALPHA})) OVER () AS wanted FROM c0 GROUP BY {k})")
        parts.append(f"s_{k}_0 AS (SELECT {k}, bound, least(wanted, bound) AS share FROM a_{k})")
        for n in range(FILLS):
            parts.append(f"s_{k}_{n + 1} AS (SELECT {k}, bound, least(bound, CASE WHEN share >= bound THEN share ELSE share * grow END) AS share FROM (SELECT *, coalesce((1.0 - coalesce(sum(share) FILTER (WHERE share >= bound) OVER (), 0.0)) / nullif(sum(share) FILTER (WHERE share < bound) OVER (), 0), 1.0) AS grow FROM s_{k}_{n}))")
        parts.append(f"t_{k} AS (SELECT {k}, share AS share_{k} FROM s_{k}_{FILLS})")
    parts.append(f"w0 AS (SELECT c0.*, share_source, share_lang, share_topic, tokens / ({BUDGET} * sum(tokens) OVER ()) AS bound, tokens AS weight FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(SWEEPS):
        for k in dims:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (least(bound, weight * share_{k} / sum(weight) OVER (PARTITION BY {k})) AS weight) FROM w{n})")
            n += 1
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, {BUDGET} * sum(tokens) OVER () * weight / tokens) AS p FROM w{n})")
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p FROM d JOIN p USING (source, lang, topic)"
        " WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < p"
    )


OP9_SQL = _sql()
