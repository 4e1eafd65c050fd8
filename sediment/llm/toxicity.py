"""Toxicity by weak supervision.

Many lexicon and pattern voters look at a bounded sample of documents, labelled and unlabelled: fixed lexicons
and patterns, and lexicons of words and word beginnings mined from the labelled rows that may be learned from (a labelled
row is voted on by what the other half of them taught). A generative label model, fitted by expectation maximisation, says
how often each voter fires on toxic and on clean documents given the voter that it depends on most: the
dependencies are the maximum spanning tree of the voters' conditional mutual information, so voters that
repeat each other count about once. A gold label is one more voter, whose accuracy is estimated like the rest; unlabelled documents have none.
Voters that never fire or tell the classes no better than chance are left out. The model's posterior labels train a linear classifier on words and
word beginnings, and that classifier scores every whole text.

Nulls and edges: a null or empty text has no features and scores the classifier's bias, which is
that of a clean document; null ids and repeated rows are scored like others; without any labelled
row the fixed voters alone label the sample; empty tables give empty results. Labels, language,
source and id are no inputs of a score. A column of the input with the score's name is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sediment.llm import wordhash
from sediment.llm.labelled import fold, labelled_sample, unlabelled_sample
from sediment.llm.staging import drop, lean, stage

SAMPLE = 6_000  # labelled documents that the voters, the label model and the classifier are fitted on
UNLABELLED = 3_000  # documents without a usable label that join them
PREFIXES = (3, 4, 5, 6, 7)
LEVELS = ((1, 0.0), (2, 1 / 600), (3, 1 / 300))  # how often a feature is there, and its share of the words
KINDS = (1 + len(PREFIXES)) * len(LEVELS)
STRENGTHS = (10.0, 40.0)  # how many times as often on toxic rows: bands of mined lexicons
FEATURES = 30_000  # most telling features that the classifier keeps
FOLDS, HELD_OUT = 4, 2

# Lexicons, one voter each.
LEXICONS = {
    "stupidity": "idiot idiots stupid moron morons dumb imbecile fool idiote imbécile crétin débile dummkopf blödmann idiota estúpido tonto imbécil",
    "contempt": "loser losers pathetic worthless clown disgusting ridiculous minable nul lächerlich wertlos patético inútil",
    "dirt": "scum trash garbage vermin filth ordure déchet abschaum müll dreck basura escoria",
    "profanity": "fuck fucking shit bitch bastard asshole crap merde connard salope putain scheiße arschloch hurensohn mierda puta cabrón",
    "threat": "kill murder die hurt destroy tuer crever töten sterben matar morir",
    "hate": "hate despise hass hasse haine odio",
}
PATTERNS = {
    "address": r"\b(?:you|you're|your|tu|du|eres)\s+(?:\w+\s+){0,2}(?:idiot|moron|loser|scum|trash|clown|stupid|pathetic|worthless|disgusting)",
    "shout": r"(?:\b[A-Z]{4,}\b\W+){3,}",
    "marks": r"[!?]{3,}",
}
_LEXICON = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
_PATTERN = {name: re.compile(p, re.I if name == "address" else 0) for name, p in PATTERNS.items()}
_WORD = re.compile(r"\w+")


def feature_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature) of the features of each text, in order.

    A feature is 27 bits of hash over its kind: a word or a beginning of so many bytes, found at all, or at least as often, in
    itself and by the text's words, as one of LEVELS says.
    """
    doc, word, _, _, *heads = wordhash.words(column, prefixes=PREFIXES)
    n_words = np.bincount(doc, minlength=len(column))
    name = lambda h, kind: (h >> np.uint64(37)) << np.uint64(5) | np.uint64(kind * len(LEVELS))
    parts, whose = [name(word, 0)], [doc]
    for kind, h in enumerate(heads, 1):
        parts.append(name(h[h != 0], kind))
        whose.append(doc[h != 0])
    both, count = np.unique(np.concatenate(whose).astype(np.uint64) << np.uint64(32) | np.concatenate(parts), return_counts=True)
    per = count / np.maximum(1, n_words[(both >> np.uint64(32)).astype(np.int64)])
    both = np.concatenate([both[(count >= n) & (per >= share)] | np.uint64(k) for k, (n, share) in enumerate(LEVELS)])
    both.sort()
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def fixed_votes(text: str) -> list[int]:
    words = set(_WORD.findall(text.lower()))
    return [int(not words.isdisjoint(lex)) for lex in _LEXICON.values()] + [int(p.search(text) is not None) for p in _PATTERN.values()]


class Rows:
    """Features, fixed votes and gold labels (nan: unknown) of sampled documents, in order of doc_id.

    ids: the sorted features that count; place: of each entry, its feature's place there; whose: its row. Eight bytes an entry.
    """

    def __init__(self, ids: np.ndarray, place: np.ndarray, sizes: np.ndarray, votes: np.ndarray, gold: np.ndarray):
        self.ids, self.place, self.votes, self.gold, self.n = ids, place, votes, gold, len(sizes)
        self.whose = np.repeat(np.arange(self.n, dtype=np.int32), sizes)

    @classmethod
    def of(cls, features: list[np.ndarray], votes: np.ndarray, gold: np.ndarray) -> Rows:
        flat = np.concatenate(features) if features else np.zeros(0, np.uint32)
        ids, place = np.unique(flat, return_inverse=True)
        return cls(ids, place.astype(np.int32), np.array([len(f) for f in features], np.int64), votes, gold)

    def seen(self, rows: np.ndarray) -> np.ndarray:
        """How many of the marked rows have each feature."""
        return np.bincount(self.place[rows[self.whose]], minlength=len(self.ids))


def find(keep: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each id's place in the sorted `keep`, or -1."""
    if not len(keep):
        return np.full(len(ids), -1)
    place = np.minimum(np.searchsorted(keep, ids), len(keep) - 1)
    return np.where(keep[place] == ids, place, -1)


def _features_of(sample: DataFrame, keep) -> pa.Table:
    """doc_id, label, features and votes of sampled rows, in order. Without `keep`, features of gold toxic rows and of voted ones without a label; else places in `keep`, of all rows."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                doc, ids = feature_ids(part.column(1))
                votes = [fixed_votes(t.as_py() or "") for t in part.column(1)]
                if keep is None:
                    label = part.column(2).to_pylist()
                    wanted = np.array([x == 1 or x is None and any(v) for x, v in zip(label, votes)], bool)[doc]
                    doc, ids = doc[wanted], ids[wanted]
                else:
                    place = find(keep.value, ids)
                    doc, ids = doc[place >= 0], place[place >= 0].astype(np.int32)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                found = [ids[bounds[k] : bounds[k + 1]].tobytes() for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary()), pa.array(votes, pa.list_(pa.int32()))], ["doc_id", "label", "features", "votes"])

    return sample.select("doc_id", "text", "label").mapInArrow(lean(run), "doc_id long, label int, features binary, votes array<int>").toArrow()


def _flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column of 32-bit numbers, and how many each row has."""
    parts, sizes = [], []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        sizes.append(np.diff(ends) // 4)
        if data is not None:
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(parts, kind), join(sizes, np.int64).astype(np.int64)


def _gather(sample: DataFrame) -> Rows:
    """The sample's Rows, with the features that two or more possibly toxic rows show; texts stay on the executors, and so do other features."""
    sample = stage(sample, "toxicity-sample")
    shown = _features_of(sample, None)
    sure = shown.filter(pc.equal(shown.column("label"), 1))
    flat, _ = _flat((sure if sure.num_rows else shown).column("features"), np.uint32)
    ids, count = np.unique(flat, return_counts=True)
    ids = ids[count >= 2]
    del shown, sure, flat, count
    table = _features_of(sample, sample.sparkSession.sparkContext.broadcast(ids)).sort_by([("doc_id", "ascending"), ("features", "ascending")])
    drop(sample)
    votes = np.array(table.column("votes").to_pylist(), float).reshape(table.num_rows, len(_LEXICON) + len(_PATTERN))
    gold = np.array([np.nan if x is None else float(x) for x in table.column("label").to_pylist()])
    return Rows(ids, *_flat(table.column("features"), np.int32), votes, gold)


def mined_votes(rows: Rows) -> np.ndarray:
    """Votes of lexicons mined from labelled rows, one lexicon a feature kind and band of strength.

    Two halves of the labelled rows teach each other; unlabelled rows are voted on by what all labelled rows teach.
    """
    known = ~np.isnan(rows.gold)
    out = np.zeros((rows.n, KINDS * len(STRENGTHS)))
    if not known.any():
        return out
    even = known & (np.cumsum(known) % 2 == 0)
    for taught, learn in ((even, known & ~even), (known & ~even, even), (~known, known)):
        toxic = learn & (rows.gold == 1)
        on, off = rows.seen(toxic), rows.seen(learn & ~toxic)
        rate = (on / max(1, toxic.sum())) / ((off + 0.5) / max(1, learn.sum() - toxic.sum()))
        voter = np.full(len(rows.ids), -1, np.int32)
        for k, low in enumerate(STRENGTHS):
            strong = (rate >= low) & (on >= 3)
            voter[strong] = (rows.ids[strong] & 31).astype(np.int32) * len(STRENGTHS) + k
        if len(voter):
            good = np.flatnonzero((voter >= 0)[rows.place] & taught[rows.whose])
            out[rows.whose[good], voter[rows.place[good]]] = 1
    return out


class LabelModel:
    """Binary voters given the class, each depending on one other voter too, and a gold voter of unknown accuracy."""

    def fit(self, votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> LabelModel:
        """gold: 1, 0, or nan for unknown."""
        known = ~np.isnan(gold)
        truth = np.where(known, gold, 0.0)
        sure = votes.any(1)
        belief = np.where(known, np.where(truth == 1, 0.95, 0.05), np.where(sure, 0.7, 0.03))
        self.gold_accuracy = 0.95
        self.parents = np.full(votes.shape[1], -1)
        for turn in range(rounds):
            self.prior = float(np.clip((belief.sum() + 1) / (len(belief) + 2), 1e-3, 1 - 1e-3))
            if turn in (0, 5, 15):  # the tree settles early and then stays, so that the likelihood can only rise
                self.parents = self._tree(votes, belief)
            self.tables = self._tables(votes, belief)
            if known.any():
                agrees = np.where(truth == 1, belief, 1 - belief)[known]
                self.gold_accuracy = float(np.clip((agrees.sum() + 19) / (known.sum() + 20), 0.6, 0.995))
            odds = self.log_odds(votes)
            odds[known] += np.where(truth[known] == 1, 1.0, -1.0) * np.log(self.gold_accuracy / (1 - self.gold_accuracy))
            belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        fires = (belief @ votes + 0.5) / (belief.sum() + 1), ((1 - belief) @ votes + 0.5) / ((1 - belief).sum() + 1)
        self.accuracy = self.prior * fires[0] + (1 - self.prior) * (1 - fires[1])
        self.lift = fires[0] / fires[1]
        self.posterior = belief
        return self

    @staticmethod
    def _pair(votes: np.ndarray, weight: np.ndarray, i: int, j: int) -> np.ndarray:
        """Smoothed share of weight at each value of voters i and j."""
        table = np.bincount((2 * votes[:, i] + votes[:, j]).astype(int), weight, 4).reshape(2, 2) + 0.25
        return table / table.sum()

    def _tree(self, votes: np.ndarray, belief: np.ndarray) -> np.ndarray:
        """Each voter's parent (-1: none) in the maximum spanning tree of mutual information given the class."""
        n = votes.shape[1]
        gain = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                for weight, share in ((belief, self.prior), (1 - belief, 1 - self.prior)):
                    p = self._pair(votes, weight, i, j)
                    gain[i, j] += share * (p * np.log(p / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))).sum()
                gain[j, i] = gain[i, j]
        parents, inside = np.full(n, -1), [0] if n else []
        while len(inside) < n:
            rest = [k for k in range(n) if k not in inside]
            k, parent = max(((k, i) for k in rest for i in inside), key=lambda x: gain[x])
            parents[k] = parent
            inside.append(k)
        return parents

    def _tables(self, votes: np.ndarray, belief: np.ndarray) -> list[np.ndarray]:
        """P(voter fires | class, parent's vote) by voter: [class, parent's vote]."""
        out = []
        for k, parent in enumerate(self.parents):
            above = votes[:, parent].astype(int) if parent >= 0 else np.zeros(len(votes), int)
            table = np.empty((2, 2))
            for y, weight in ((0, 1 - belief), (1, belief)):
                fired, seen = np.bincount(above, weight * votes[:, k], 2), np.bincount(above, weight, 2)
                whole = (fired.sum() + 0.5) / (seen.sum() + 1)
                table[y] = (fired + 4 * whole) / (seen + 4)  # rare parent votes lean on the voter's own rate
            out.append(np.clip(table, 1e-4, 1 - 1e-4))
        return out

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k, (parent, table) in enumerate(zip(self.parents, self.tables)):
            above = votes[:, parent].astype(int) if parent >= 0 else np.zeros(len(votes), int)
            on, off = table[1][above], table[0][above]
            out += np.where(votes[:, k] == 1, np.log(on / off), np.log((1 - on) / (1 - off)))
        return out


def label_rows(rows: Rows) -> LabelModel:
    """The label model over all voters that fire and tell the classes apart."""
    votes = np.concatenate([rows.votes, mined_votes(rows)], 1)
    votes = votes[:, votes.sum(0) >= 2]
    model = LabelModel().fit(votes, rows.gold)
    telling = np.abs(np.log(model.lift)) > np.log(1.25)
    return model if telling.all() else LabelModel().fit(votes[:, telling], rows.gold)


class Linear:
    """Weights of sorted features and a bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias

    def scores(self, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        place = find(self.ids, ids)
        hit = place >= 0
        logit = self.bias + np.bincount(doc[hit], self.weights[place[hit]], n)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(rows: Rows, target: np.ndarray, keep: int = FEATURES, ratio: float = 12.0, steps: int = 300) -> Linear:
    """Logistic regression on the presence of features that mark toxic rows. target: posterior labels.

    Weights stay non-negative, so a long clean text gathers no evidence for or against by its length.
    """
    on = np.bincount(rows.place, target[rows.whose], len(rows.ids))
    off = np.bincount(rows.place, minlength=len(rows.ids)) - on
    lift = ((on + 0.1) / (target.sum() + 1)) / ((off + 0.1) / ((1 - target).sum() + 1))
    chosen = np.flatnonzero((on >= 1.9) & (lift >= ratio))
    chosen = np.sort(chosen[np.argsort(-(on * np.log(lift))[chosen], kind="stable")[:keep]])
    slot = np.full(len(rows.ids), -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    hit = np.flatnonzero((slot >= 0)[rows.place]) if len(slot) else np.zeros(0, np.int64)
    r, c = rows.whose[hit], slot[rows.place[hit]]
    w, bias = np.full(len(chosen), 0.1), -3.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(target > 0.5, np.clip(0.5 * len(target) / max(1.0, target.sum()), 1, 4), 1.0) / max(1, len(target))
    for step in range(1, steps + 1):
        logit = bias + np.bincount(r, w[c], rows.n)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * balance
        g, gb = np.bincount(c, error[r], len(w)) + 0.1 * w / max(1, len(w)), error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w = np.maximum(0, w - 0.1 * (m / a) / (np.sqrt(v / b) + 1e-8))
        bias = min(bias - 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-8), -1.5)
    return Linear(rows.ids[chosen], w, bias)


def train(sample: DataFrame) -> Linear:
    rows = _gather(sample)
    if not rows.n:
        return Linear(np.zeros(0, np.uint32), np.zeros(0), -4.0)
    return fit_linear(rows, label_rows(rows).posterior)


def score_texts(docs: DataFrame, model: Linear, name: str = "score") -> DataFrame:
    """`docs` with its score in column `name`. The weights, at most FEATURES of them, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(name)
    schema = StructType([*plain.schema.fields, StructField(name, DoubleType())])
    at = plain.columns.index("text")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                doc, ids = feature_ids(part.column(at))
                score = shared.value.scores(doc, ids, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

    return plain.mapInArrow(lean(run), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, unlabelled: int = UNLABELLED, name: str = "score") -> DataFrame:
    """`docs` with a score (0 to 1) in column `name`, fitted on labelled rows outside the held-out fold and on rows without a label."""
    known = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, limit)
    return score_texts(docs, train(known.unionByName(unlabelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, unlabelled))), name)


def op10_weak_supervision_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
