"""URL filters by Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus's complete key universe
that level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly accepts, and so on
until no error is left. A key of the universe is listed if the first level that rejects it is even.
Membership is therefore exact for every key the corpus can ask, with no join: the levels are
literals inside one expression, and their size follows the list (about log2(universe/list) bits
a listed key), not the corpus. Building it is aggregation only.

Keys are host suffixes ("example.org") and host suffixes with a path prefix ("example.org/es/").

Nulls and edges: a null url or one without "://" has an empty host and path, fits no rule and is
allowed; empty listings and empty tables work; repeated rows are judged alike; other columns,
null ids included, pass through the operator unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.staging import drop, stage

MAX_FILTER_BYTES = 16 << 20  # of all levels together, about ten million listed keys among a billion; a list beyond it is refused, never cut
MAX_LEVELS = 64

#: (action, host, path): the longest rule that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Host labels with one of these hyphen-separated parts put the host on the default block list.
BLOCKED_PARTS = ("adult", "bets", "betting", "casino", "payday", "pills", "poker", "porn", "viagra", "xxx")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: str  # 64-bit words in decimal, comma-separated


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; empty for an empty host."""
    labels = F.split(host, r"\.", -1)
    each = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(host != "", each).otherwise(F.array().cast("array<string>"))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes, each with the path's prefixes of the given lengths, the longest key first."""
    cut = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: n <= F.length(path))
    each = F.flatten(F.transform(host_suffixes(host), lambda s: F.transform(cut, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))
    ranked = F.array_sort(F.transform(each, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.transform(ranked, lambda x: x.k)


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(seed + 1000)), F.lit(bits))
    return [F.pmod(first + F.lit(j) * step + F.lit(j * j), F.lit(bits)) for j in range(hashes)]


def _accepts(level: Level, key: Column) -> Column:
    """The level's words stand once in the plan, as one constant array that every position looks into."""
    words = F.split(F.lit(level.words), ",").cast("array<bigint>")
    return F.forall(F.array(*_positions(key, level.bits, level.hashes, level.seed)), lambda at: F.bit_get(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)


class BloomCascade:
    """Exact membership of `listed` among `universe` (both: one string column `key`, distinct or not)."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(x.bits // 8 for x in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed. For other keys the answer may be wrong either way."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(_accepts(self.levels[k], key), out).otherwise(F.lit(k % 2 == 1))
        return out

    @classmethod
    def build(cls, universe: DataFrame) -> BloomCascade:
        """`universe`: a staged table (key string, listed boolean), one row a key."""
        counts = {r[0]: r[1] for r in universe.groupBy("listed").count().collect()}
        levels: list[Level] = []
        inside, outside = counts.get(True, 0), counts.get(False, 0)
        rows, total = universe, 0
        while inside:
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end: keys with equal 64-bit hashes on both sides")
            rate = 0.5 if levels else max(1e-9, min(0.5, inside / (math.sqrt(2) * max(1, outside))))
            hashes = max(1, round(-math.log2(rate)))
            bits = 64 * max(1, math.ceil(inside * hashes / math.log(2) / 64))
            total += bits // 8
            if total > MAX_FILTER_BYTES:
                raise ValueError(f"the list needs a cascade of more than {MAX_FILTER_BYTES} bytes; raise MAX_FILTER_BYTES or split the list by key")
            seed = 2 * len(levels)
            encoded = rows.filter(F.col("listed") == F.lit(len(levels) % 2 == 0))
            at = encoded.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
            words = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
            full = [0] * (bits // 64)
            for r in words.collect():
                full[r.w] = r.v
            levels.append(Level(bits, hashes, seed, ",".join(map(str, full))))
            # what this level accepts goes on; of it, only the other side needs encoding next
            rows = rows.filter(_accepts(levels[-1], F.col("key")))
            left = {r[0]: r[1] for r in rows.groupBy("listed").count().collect()}
            inside, outside = (left.get(len(levels) % 2 == 0, 0), left.get(len(levels) % 2 == 1, 0))
        return cls(levels)


def _universe(pages: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """The distinct keys of all pages with whether the list (key) has them, staged; hot hosts shrink before the shuffle. The list meets the keys here, once, by a join; pages never do."""
    known = pages.select(F.explode(keys).alias("key")).distinct()
    marked = known.join(listed.select("key").distinct().withColumn("_in", F.lit(True)), "key", "left")
    return stage(marked.select("key", F.coalesce("_in", F.lit(False)).alias("listed")), "url-keys")


def hosts_with_parts(pages: DataFrame, url: str = "url", parts=BLOCKED_PARTS) -> DataFrame:
    """A block list (host): every host or parent domain in the corpus whose first label has one of the hyphen-separated parts."""
    hosts = pages.select(F.explode(host_suffixes(host_of(F.col(url)))).alias("host")).distinct()
    pattern = "(^|-)(" + "|".join(parts) + ")(-|$)"
    return hosts.filter(F.split("host", r"\.", -1)[0].rlike(pattern)) if parts else hosts.limit(0)


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, blocked_hosts: DataFrame | None = None) -> DataFrame:
    """`pages` with _host, _path, _rule and _verdict (columns of those names are replaced).

    rules: (action, host, path) triples or a table of them; blocked_hosts: a table (host), by default `hosts_with_parts`. A rule's verdict
    stands; else a page is blocked if its host or a parent domain is listed.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    listed = table.select("action", F.concat("host", "path").alias("key"), F.length("path").alias("n"))
    blocked_hosts = hosts_with_parts(pages, url) if blocked_hosts is None else blocked_hosts
    parsed = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # at most as many as a url has characters
    rule_keys = candidate_keys(F.col("_host"), F.col("_path"), lengths) if lengths else F.array().cast("array<string>")
    tables = {action: _universe(parsed, rule_keys, listed.filter(F.col("action") == action)) for action in ("allow", "block")}
    tables["host"] = _universe(parsed, host_suffixes(F.col("_host")), blocked_hosts.select(F.col("host").alias("key")))
    cascades = {name: BloomCascade.build(keys) for name, keys in tables.items()}
    drop(*tables.values())
    first = lambda c: F.get(F.filter(rule_keys, c.contains), F.lit(0))
    allow, block = first(cascades["allow"]), first(cascades["block"])
    judged = parsed.withColumn("_rule", F.struct(allow.alias("allow"), block.alias("block")))
    allow, block = F.col("_rule.allow"), F.col("_rule.block")
    allow_wins = allow.isNotNull() & (block.isNull() | (F.length(allow) > F.length(block)))
    bad_host = F.exists(host_suffixes(F.col("_host")), cascades["host"].contains)
    verdict = F.when(allow_wins, "allow").when(block.isNotNull() | bad_host, "block").otherwise("allow")
    return judged.withColumns({"_rule": F.when(allow_wins, allow).otherwise(block), "_verdict": verdict})


def op1_bloom_cascade_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT page_id, host, path, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])(adult|bets|betting|casino|payday|pills|poker|porn|viagra|xxx)([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
