"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from its own and its neighbours' features and from
the label before it. Training lines take their document's quality label at first; lines of bad
documents that the model finds clean are relabelled once and the model is fitted again. A
document's quality is the length-weighted mean of its lines' forward-backward marginals, turned
into a probability by a logistic curve fitted on the same bounded sample.

Nulls and edges: a null or empty text, or one of white space, has no line and scores EMPTY; null
ids and repeated rows are scored like others; without any labelled row every text scores 0.5;
empty tables give empty results. Labels, language, source and id are no inputs of a score. A
column named `score` of the input is replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sediment.llm.labelled import fold, labelled_sample

SAMPLE = 4_000  # labelled documents that the field is fitted on
CHAIN = 64  # lines: a training text of more is cut into chains of so many, scoring always takes whole texts
CHAINS = 8_000  # chains that the field is fitted on, chosen by hash: at most CHAIN * CHAINS lines reach the driver
FOLDS, HELD_OUT = 5, 0
EMPTY = 0.05
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
N_OWN = 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_OWN features, line lengths) of the lines that hold a word."""
    rows, lengths = [], []
    seen: set[str] = set()
    for line in text.split("\n"):
        words = [w for w in _SPACE.split(line) if w]
        if not words:
            continue
        n, chars = len(words), len(line)
        letters = max(1, sum(map(str.isalpha, line)))
        kinds = Counter(words)
        top = kinds.most_common(1)[0][1]
        grams = Counter(zip(words, words[1:], words[2:], words[3:])) if n >= 5 else {}
        repeated = sum(c for c in grams.values() if c > 1)
        bare = len(line.translate(_SYMBOLS))
        again = line in seen
        seen.add(line)
        rows.append((
            1.0,
            min(np.log1p(n), 7.0) / 4,
            min(chars / n, 30.0) / 8,
            min((chars - bare) / n, 4.0),
            sum(map(str.isupper, line)) / letters,
            min(line.count("!") / n, 3.0),
            min(line.count("|") / n, 2.0),
            sum(map(str.isdigit, line)) / max(1, chars),
            1.0 - len(kinds) / n,
            top / n if n >= 5 else 0.0,
            repeated / max(1, n - 3),
            float(again),
            float(line[-1] in ".!?:;\"'"),
            float(n < 4),
        ))
        lengths.append(chars)
    return np.array(rows, np.float32).reshape(-1, N_OWN), np.array(lengths, np.float64)


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features; zeros beyond a text's ends. `starts`: first row of each text."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts], after[starts[1:] - 1], after[-1:] = 0, 0, 0
    return np.concatenate([x, before, after], 1)


def _lockstep(counts: np.ndarray):
    """Texts by falling line count, and how many of them have a line at each step."""
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max(initial=0))
    active = np.searchsorted(-counts[order], -np.arange(1, longest + 1), "right")
    return order, active


class LineField:
    """Two-state chain: state 1 (bad) scores x.w, state 0 scores 0; `pair` scores the step from one state to the next."""

    def __init__(self, width: int):
        self.w, self.pair, self.start = np.zeros(width), np.zeros((2, 2)), np.zeros(2)

    def marginals(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        """(P(bad) of every line, expected steps by state pair, expected first states), texts in lockstep."""
        emit = np.clip(x @ self.w, -30, 30)
        order, active = _lockstep(counts)
        first = starts[order]
        forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        jump = np.exp(self.pair - self.pair.max())
        gain = np.stack([np.ones(len(x)), np.exp(emit)], 1)
        for t, n in enumerate(active):
            at = first[:n] + t
            f = gain[at] * (np.exp(self.start) if t == 0 else forward[at - 1] @ jump)
            forward[at] = f / f.sum(1, keepdims=True)
        steps = np.zeros((2, 2))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            last = counts[order[:n]] == t + 1
            backward[at[last]] = 0.5
            on = at[~last]
            if len(on):
                b = (gain[on + 1] * backward[on + 1]) @ jump.T
                joint = forward[on][:, :, None] * jump * (gain[on + 1] * backward[on + 1])[:, None, :]
                steps += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                backward[on] = b / b.sum(1, keepdims=True)
        p = forward * backward
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        return p[:, 1], steps, p[starts].sum(0)

    def fit(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, counts: np.ndarray, weight: float, rounds: int = 120, rate: float = 0.1) -> LineField:
        """Adam on the log-likelihood of line labels y (1: bad); bad lines' features weigh `weight`."""
        inner = np.ones(len(x), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        seen_steps = np.zeros((2, 2))
        np.add.at(seen_steps, (y[at - 1], y[at]), 1)
        seen_first = np.array([(y[starts] == 0).sum(), (y[starts] == 1).sum()], float)
        scale = np.where(y == 1, weight, 1.0)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.pair, self.start)]
        for k in range(1, rounds + 1):
            bad, steps, begin = self.marginals(x, starts, counts)
            grads = (x.T @ ((y - bad) * scale) / len(x) - 1e-4 * self.w, (seen_steps - steps) / len(x) - 1e-4 * self.pair, (seen_first - begin) / len(x))
            for p, g, s in zip((self.w, self.pair, self.start), grads, state):
                s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.99 * s[1] + 0.01 * g * g
                p += rate * (s[0] / (1 - 0.9**k)) / (np.sqrt(s[1] / (1 - 0.99**k)) + 1e-8)
        return self


class QualityModel:
    """The field and the curve that turns length-weighted goodness into the probability of label 1."""

    def __init__(self, field: LineField, slope: np.ndarray):
        self.field, self.slope = field, slope

    def scores(self, own: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        counts = np.array([len(x) for x in own])
        out = np.full(len(own), EMPTY)
        some = np.flatnonzero(counts)
        if len(some):
            starts = np.cumsum(counts[some]) - counts[some]
            bad, _, _ = self.field.marginals(with_neighbours(np.concatenate([own[k] for k in some]), starts), starts, counts[some])
            out[some] = _curve(_summary(bad, np.concatenate([lengths[k] for k in some]), starts), self.slope)
        return out


def _summary(bad: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: 1, and the logit of the length-weighted mean of P(good)."""
    good = np.add.reduceat((1 - bad) * length, starts) / np.add.reduceat(length, starts)
    good = np.clip(good, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(good)), np.log(good / (1 - good))], 1)


def _curve(z: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ slope, -30, 30)))


def _fit_curve(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    slope = np.array([0.0, 1.0])
    for _ in range(50):  # Newton with a little shrinkage towards the identity curve
        p = _curve(z, slope)
        g = z.T @ (y - p) - 0.1 * (slope - np.array([0.0, 1.0]))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        slope = slope + np.clip(np.linalg.solve(h, g), -1, 1)
    return slope


def train(sample: DataFrame) -> QualityModel | None:
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                x, length = line_features(text or "")
                rows += [(doc_id, k, label, x[k : k + CHAIN].tobytes(), length[k : k + CHAIN].tobytes()) for k in range(0, len(x), CHAIN)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "line", "label", "x", "length"])

    chains = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, line long, label int, x binary, length binary")
    some = chains.orderBy(F.xxhash64("doc_id", "line"), "doc_id", "line").limit(CHAINS)
    table = some.toArrow().sort_by([("doc_id", "ascending"), ("line", "ascending")])
    if not table.num_rows:
        return None
    own = [np.frombuffer(b, np.float32).reshape(-1, N_OWN) for b in table.column("x").to_pylist()]
    length = np.concatenate([np.frombuffer(b, np.float64) for b in table.column("length").to_pylist()])
    label = table.column("label").to_numpy()
    counts = np.array([len(x) for x in own])
    starts = np.cumsum(counts) - counts
    x = with_neighbours(np.concatenate(own), starts)
    y = np.repeat(1 - label, counts)
    weight = float(np.clip((y == 0).sum() / max(1, (y == 1).sum()), 1, 5))
    field = LineField(x.shape[1]).fit(x, y, starts, counts, weight)
    bad, _, _ = field.marginals(x, starts, counts)
    worst = np.repeat(np.maximum.reduceat(bad, starts), counts)
    y = np.where((y == 1) & (bad < 0.2) & (bad < worst), 0, y)
    field = LineField(x.shape[1]).fit(x, y, starts, counts, weight)
    bad, _, _ = field.marginals(x, starts, counts)
    return QualityModel(field, _fit_curve(_summary(bad, length, starts), label.astype(float)))


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """`docs` with score: the probability of quality label 1."""
    model = train(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, limit))
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                both = [line_features(t.as_py() or "") for t in part.column(at)]
                score = shared.value.scores([x for x, _ in both], [n for _, n in both])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op8_line_crf_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
