"""Secret scans: pattern spans, and credential-context values judged by a password guess-cost dynamic program.

Base kinds (assign, access, hex) are plain patterns. The method adds kind `guess`: in credential
contexts that the base patterns miss ("passphrase is ...", "pwd -> ...", "DB_PWD=..."), a value counts
when the cheapest way to guess it costs at least `min_bits`. A value that a base span covers in part,
up to its first symbol, is judged as a whole; only one it covers wholly is left to it. A quoted value
ends at its quote. The cost is a minimum-cost segmentation of the
value into dictionary words, dates, repeats, keyboard walks and brute-force spans, found left to
right by dynamic programming in time linear in the value's length. The dictionary is a short fixed list and
the corpus's own most frequent words (`ranked_words`).

Nulls and edges: a null or empty text has no spans; every row gives one result row, repeated rows
and null ids included; whole texts are scanned whatever their length; other columns are ignored.
Positions are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.staging import lean

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_ -]?key|private[_ -]?key)(?:[_-][A-Za-z0-9_-]{0,64})?["']?\x20*(?:is|was|->|=>|:=|[:=])\x20*(["'`]?)([!-~]{6,})""", re.I | re.A)
VALUE = re.compile(r"[!-~]+")
KEYWORDS = ("pass", "pwd", "secret", "token", "credential", "key")
KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 36.0
WORDS = 20_000  # most frequent words of the corpus that join the dictionary
_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long,bits:double>>"

# Common words and passwords, in order of rank.
COMMON = (
    "the of and to in is you that it he was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their "
    "said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now "
    "people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our me man "
    "password passwd admin root login welcome letmein master monkey dragon qwerty iloveyou sunshine princess football baseball shadow secret test guest user changeme default "
    "example placeholder dummy sample token apikey none null true false yes unknown forgotten required"
).split()
RANK = {w: k + 1 for k, w in reversed(list(enumerate(COMMON)))}
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_COLUMN = {c: k for row in ROWS for k, c in enumerate(row)}
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
_NEXT |= {(b, a) for a, b in _NEXT}
LEET = str.maketrans("4@301!$57", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


PART = 1.0  # bits that say what kind of segment comes next
STEP, TURN = 0.25, 2.0  # bits of a further key of a keyboard walk, and of one that turns back
FIRST_KEY = math.log2(sum(map(len, ROWS)))
LONGEST = 24  # letters of a dictionary word


def _brute_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def word_bits(part: str, rank: dict[str, int]) -> float:
    """Bits of a dictionary word, plain or with look-alike signs for letters, in some mix of cases; infinite for others."""
    low = part.lower()
    shape = 0.0 if part == low else 1.0 if part.istitle() or part.isupper() else float(len(part))
    best = math.inf
    for form, extra in ((low, 0.0), (low.translate(LEET), 2.0)):
        if form in rank:
            best = min(best, PART + math.log2(rank[form] + 1) + extra + shape)
    return best


def repeat_bits(c: str, n: int) -> float:
    return PART + _brute_bits(c) + math.log2(n)


def date_bits(n: int) -> float:
    return PART + math.log2(120 * 365 if n > 4 else 120)


def guess_bits(value: str, rank: dict[str, int] = RANK) -> float:
    """log2 of the guesses that the cheapest segmentation of `value` needs. The empty value costs nothing.

    Dynamic programming over places. What a place is reached by matters to what follows, so it has a least cost for each state: at
    a segment's end, inside a brute-force span, and inside a keyboard walk by direction and whether it has the three keys that
    a walk needs. Words and dates are short. A repeat can be any stretch of three or more of a run; only those that begin within a
    word's length of the run's start and end within one of its end can be of use, since two neighbouring repeats, or a
    brute-force span beside one, cost more than one repeat over both. The time is linear in the value's length.
    """
    n, low = len(value), value.lower()
    inf = math.inf
    ended = [inf] * (n + 1)  # least cost of the first k characters with a segment ending there that isn't brute force
    ended[0] = 0.0
    runs: dict[int, tuple[int, int]] = {}  # place: the run of equal characters that it lies in
    a = 0
    for k in range(1, n + 1):
        if k == n or low[k] != low[a]:
            if k - a >= 3:
                for i in range(a, min(k - 2, a + LONGEST + 1)):
                    runs[i] = (a, k)
            a = k
    brute = begun = inf  # begun: a walk of the last key alone
    walk = {(step, long): inf for step in (-1, 1) for long in (False, True)}
    for k in range(n):
        here = min(ended[k], brute, walk[-1, True], walk[1, True])
        ended[k] = min(ended[k], walk[-1, True], walk[1, True])
        if value[k].isdigit():
            for j in (k + 4, k + 8, k + 10):
                if j <= n and DATE.fullmatch(value, k, j):
                    ended[j] = min(ended[j], here + date_bits(j - k))
        if k in runs:
            _, stop = runs[k]
            for j in range(max(k + 3, stop - LONGEST), stop + 1):
                ended[j] = min(ended[j], here + repeat_bits(value[k], j - k))
        for j in range(k + 3, min(n, k + LONGEST) + 1):
            bits = word_bits(value[k:j], rank) if low[k:j] in rank or low[k:j].translate(LEET) in rank else inf
            if here + bits < ended[j]:
                ended[j] = here + bits
        brute = min(brute, ended[k] + PART) + _brute_bits(value[k])
        after = {(d, long): inf for d in (-1, 1) for long in (False, True)}
        back = _walk_step(low, k) if k else 0
        if back:
            after[back, False] = begun + STEP
            after[back, True] = min(walk[back, False], walk[back, True], walk[-back, False] + TURN, walk[-back, True] + TURN) + STEP
        walk = after
        begun = here + PART + FIRST_KEY if low[k] in _COLUMN else inf
    return min(ended[n], brute, walk[-1, True], walk[1, True])


def _walk_step(low: str, k: int) -> int:
    """The direction from key k - 1 to its neighbour key k, or 0."""
    if (low[k - 1], low[k]) not in _NEXT:
        return 0
    return 1 if _COLUMN[low[k]] > _COLUMN[low[k - 1]] else -1


def find_spans(text: str, min_bits: float = MIN_BITS, rank: dict[str, int] = RANK) -> list[tuple[int, int, int, float]]:
    """(start, kind index, end, guess bits) of every secret in `text`, in order of start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        held, values = [], {}
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                held.append((m.start(), m.end()))
                found.append((m.start(), 0, m.end(), guess_bits(m[2], rank)))
            quote = text[m.start(2) - 1]
            values[m.start(2)] = quote if quote in "\"'" else ""
        values.update((m.start(2), m[1]) for m in CONTEXT.finditer(text))
        starts, upto = [x for x, _ in held], 0
        for a in sorted(values):
            if a < upto:  # within a value that was judged
                continue
            value = VALUE.match(text, a)[0]
            if values[a]:
                value = re.split(rf"(?<!\\){values[a]}", value, maxsplit=1)[0]
            upto = a + len(value)
            value = value.rstrip("\"'`.,;:!?)")
            b = a + len(value)
            k = bisect.bisect_right(starts, a) - 1
            if len(value) >= 6 and not (k >= 0 and b <= held[k][1]) and (bits := guess_bits(value, rank)) >= min_bits:
                if text[a:upto].endswith(("!", "?")) and k >= 0 and held[k][1] > a:
                    b = upto  # the rest of an assigned password, not the end of a sentence
                found.append((a, 3, b, bits))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), guess_bits(m[0][4:], rank)) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), 4.0 * (m.end() - m.start())) for m in HEX.finditer(text)]
    return sorted(found)


def ranked_words(docs: DataFrame, text: str = "text", limit: int = WORDS) -> dict[str, int]:
    """Ranks of dictionary words: the fixed list first, then the most frequent words of all documents (a to z, 4 to LONGEST letters), up to `limit` of them.

    The counting covers every text, in SQL functions with map-side sums; the limit bounds what the driver gets (about 1 MB) and the workers keep.
    """
    word = F.explode(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z]+"))
    counted = docs.select(word.alias("word")).filter(F.length("word").between(4, LONGEST)).groupBy("word").count()
    top = counted.filter("count > 1").orderBy(F.desc("count"), "word").limit(limit).select("word").collect()
    out = dict(RANK)
    for r in top:
        if len(set(r.word)) > 1:
            out.setdefault(r.word, len(out) + 1)
    return out


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", min_bits: float = MIN_BITS, rank: dict[str, int] | None = None) -> DataFrame:
    """doc_id and its spans (kind, start, stop, bits), one row per row of `docs`. rank: dictionary words by rank, the fixed list if not given."""
    shared = docs.sparkSession.sparkContext.broadcast(RANK if rank is None else rank)

    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "stop": b, "bits": bits} for a, k, b, bits in find_spans(t.as_py() or "", min_bits, shared.value)] for t in batch.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), _SCHEMA)


def redact_text(text: str | None, min_bits: float = MIN_BITS, mark: str = "[SECRET]", rank: dict[str, int] = RANK) -> str | None:
    """`text` with every span replaced; overlapping spans become one mark."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b, _ in find_spans(text, min_bits, rank):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, min_bits: float = MIN_BITS, rank: dict[str, int] | None = None) -> DataFrame:
    """`docs` with secrets in text replaced and n_chars, if there, following; no row goes and no other column changes."""
    shared = docs.sparkSession.sparkContext.broadcast(RANK if rank is None else rank)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = [redact_text(t, min_bits, rank=shared.value) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([n if t is None else len(t) for t, n in zip(texts, old)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def op2_guess_cost_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs, rank=ranked_words(docs))
    name = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", F.transform(F.filter("spans", lambda x: x.kind != "guess"), name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", name)).alias("spans"),
    )
