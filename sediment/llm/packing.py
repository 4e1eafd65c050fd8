"""Best-fit packing of tokenised documents into fixed-length training sequences (vector best-fit).

`tokenize_pieces` turns each document into token ids followed by an end id and cuts only what
exceeds the sequence length. `pack_pieces` places pieces by vector best-fit: each bin has a
residual (tokens, documents, attention cost), a piece goes to the open bin that satisfies every
constraint and scores best, by the weighted norm of what would remain or by the weighted
dot-product of piece and residual. `fill_sequences` joins ids and placement into the packed rows.

Nulls and edges: a null or empty text is the end id alone; a null doc_id is packed like any other;
repeated rows and ties are packed separately, in the order of (length desc, doc_id, piece);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sediment.llm.staging import kept_caches, lean, stage

CACHE_CHUNKS = 800_000  # distinct text chunks whose ids a worker keeps; the cache starts anew beyond it
GROUP_PIECES = 20_000  # pieces packed together: a group wastes at most about one bin in several thousand
_MARKS = ".,;:!?&%$#*|()[]{}/+=-_\""  # that may follow a word within a chunk and never join its letters
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordMerger:
    """Byte-pair merges of many words at once, for tokenizers whose words are letters with an end mark.

    Each round merges, in every word that still has one, the leftmost pair of the lowest rank; that is
    what the tokenizer does word by word. `words` takes lower-case words of letters below U+0130, which
    normalisation leaves as they are and pre-tokenisation leaves whole.
    """

    def __init__(self, spec: dict):
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a vocabulary; others follow from U+0100 on
        sign = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[sign[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)

    @classmethod
    def of(cls, spec: dict) -> WordMerger | None:
        """None for a tokenizer of another kind."""
        model, text = spec["model"], json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        plain = not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and model.get("end_of_word_suffix")
        return cls(spec) if model.get("type") == "BPE" and plain and "Lowercase" in text and "ByteLevel" in text and "|[\\\\p{L}]+|" in text else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], self.none)

    def words(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, little-endian uint32."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        out: list[bytes] = [b""] * len(raw)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            for k in range(0, len(rows), max(1, 2_000_000 // n)):
                some = rows[k : k + max(1, 2_000_000 // n)]
                data = np.frombuffer(b"".join(raw[i] for i in some.tolist()), np.uint8).reshape(-1, n)
                ids = self.inner[data]
                ids[:, -1] = self.final[data[:, -1]]
                self._merge(ids)
                length = (ids >= 0).sum(1)
                flat, stop = ids[ids >= 0].astype("<u4").tobytes(), (4 * np.cumsum(length)).tolist()
                for i, a, b in zip(some.tolist(), [0, *stop], stop):
                    out[i] = flat[a:b]
        return out

    def _merge(self, ids: np.ndarray) -> None:
        """In place; what a merge frees at a row's end becomes -1."""
        n = ids.shape[1]
        if n < 2:
            return
        rank = np.full(ids.shape, self.none)  # of the pair that begins here
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        place = np.arange(n)
        while True:
            best = rank.argmin(1)
            low = rank[np.arange(len(rank)), best]
            on = low < self.none
            if not on.all():
                live, rank, best, low = live[on], rank[on], best[on], low[on]
            if not len(live):
                return
            each = np.arange(len(live))
            take = place + (place > best[:, None])
            take[take == n] = n - 1
            mine = ids[live[:, None], take]
            mine[:, -1] = -1
            mine[each, best] = self.made[low]
            rank = rank[each[:, None], take]
            rank[:, -1] = self.none
            after = mine[each, np.minimum(best + 1, n - 1)]
            rank[each, best] = np.where(best + 1 < n, self._rank(mine[each, best], after), self.none)
            inner = np.flatnonzero(best > 0)
            rank[inner, best[inner] - 1] = self._rank(mine[inner, best[inner] - 1], mine[inner, best[inner]])
            ids[live] = mine


class ChunkEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    space-separated chunks in order; frequent chunks come from a cache. A chunk of Latin letters and
    a tail of marks is the lower-cased word and the tail: the tokenizer lower-cases and splits letters from marks, so
    case and tail variants share one word. New words are merged together, other new chunks go to the tokenizer.
    """

    def __init__(self, path: str | None, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merger = WordMerger.of(json.load(f))
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        for k in range(0, len(chunks), 4096):
            some = chunks[k : k + 4096]
            for chunk, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[chunk] = np.array(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        known = self.known
        new = set().union(*parts).difference(known)
        plain, variants = set(), []
        if self.merger is None:
            plain = new
        else:
            words = set()
            for chunk in new:
                word = chunk if chunk.isalpha() else chunk.rstrip(_MARKS)
                if word.isalpha() and len(word) <= 64 and max(word) < "\u0130":
                    stem = word.lower()
                    words.add(stem)
                    if stem != chunk:
                        variants.append((chunk, stem, chunk[len(word) :]))
                else:
                    plain.add(chunk)
            plain.update(mark for _, _, mark in variants if mark)
            words = sorted(words.difference(known))
            known.update(zip(words, self.merger.words(words)))
        self._learn(sorted(plain.difference(known)))
        for chunk, stem, mark in variants:
            known[chunk] = known[stem] + known[mark] if mark else known[stem]
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for chunk in new:
            if len(chunk) > 64:
                del known[chunk]
        return out


_encoders: dict[tuple, ChunkEncoder] = {}  # of this worker process, kept from task to task
kept_caches.append(_encoders)


def encoder_of(path: str | None, name: str) -> ChunkEncoder:
    if (path, name) not in _encoders:
        _encoders[path, name] = ChunkEncoder(path, name)
    return _encoders[path, name]


def _texts(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about `limit` characters."""
    at, size, run = 0, 0, []
    for k, text in enumerate(batch.column(column)):
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= limit:
            yield at, run
            at, size, run = k + 1, 0, []
    if run:
        yield at, run


def tokenize_pieces(docs: DataFrame, max_tokens: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32, if kept)."""
    width = 4 * max_tokens
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(path, tokenizer)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, texts in _texts(batch, "text"):
                rows = []
                for doc_id, blob in zip(ids[at : at + len(texts)], encoder.encode(texts)):
                    blob += tail
                    for piece, a in enumerate(range(0, len(blob), width)):
                        cut = blob[a : a + width]
                        rows.append((doc_id, piece, a // 4, len(cut) // 4, zlib.crc32(cut), *([cut] if keep_ids else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return docs.select("doc_id", "text").mapInArrow(lean(run, keep=True), _PIECE + ", ids binary" * keep_ids)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, taken in the given order. Every bin keeps tokens, pieces and summed squares within the capacities."""
    n = len(lengths)
    capacity = np.array([max_tokens, max_docs, max_cost], float)
    w = np.array(weights, float)
    left = np.empty((3, 64))
    ids, used, opened = np.empty(64, np.int64), np.empty(64, np.int64), 0
    bins, offsets, made = np.empty(n, np.int64), np.empty(n, np.int64), 0
    for k in range(n):
        size = np.array([lengths[k], 1.0, float(lengths[k]) ** 2])
        if opened:
            rest = left[:, :opened] - size[:, None]
            fits = (rest >= 0).all(0)
            if fits.any():
                at = np.flatnonzero(fits)
                if rule == "dot":
                    score = -(w * size / capacity**2) @ left[:, at]
                else:
                    score = w @ (rest[:, at] / capacity[:, None]) ** 2
                b = at[np.argmin(score)]
                bins[k], offsets[k] = ids[b], used[b]
                left[:, b] = rest[:, b]
                used[b] += lengths[k]
                if left[:2, b].min() < 1 or left[2, b] < 1:  # full: nothing fits any more
                    opened -= 1
                    left[:, b], ids[b], used[b] = left[:, opened], ids[opened], used[opened]
                continue
        if (size > capacity).any():
            raise ValueError("a piece is larger than an empty sequence allows")
        if opened == len(ids):
            left = np.concatenate([left, np.empty_like(left)], 1)
            ids, used = np.append(ids, np.empty_like(ids)), np.append(used, np.empty_like(used))
        bins[k], offsets[k] = made, 0
        left[:, opened], ids[opened], used[opened] = capacity - size, made, lengths[k]
        made += 1
        opened += bool(left[:2, opened].min() >= 1 and left[2, opened] >= 1)
    return bins, offsets


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, max_docs: int = 4096, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.3, 0.3), rule: str = "norm") -> DataFrame:
    """`pieces` with sequence_id and offset.

    Pieces are dealt in turn, by a row number that the staged table fixes, to groups of about GROUP_PIECES, and each group is
    packed alone: equal or null ids spread like others. Only key and length columns move. `max_cost` bounds the sum of squared
    piece lengths of a sequence.
    """
    cost = float(max_tokens) ** 2 if max_cost is None else float(max_cost)
    columns = pieces.columns
    staged = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-staged.count() // GROUP_PIECES))
    dealt = staged.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("_row", "ascending")])
        base = table.column("_group")[0].as_py() << 32
        bins, offsets = best_fit(table.column("length").to_numpy(), max_tokens, max_docs, cost, weights, rule)
        return table.select(columns).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.groupBy("_group").applyInArrow(pack, schema)


def fill_sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, ids (binary, little-endian uint32), n_tokens, n_pieces. A sequence has at most max_docs short pieces, so its group is bounded."""
    keys = ["doc_id", "piece", "start"]
    parts = pieces_with_ids.select(*keys, "ids").join(placed.select(*keys, "length", "sequence_id", "offset"), keys)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return parts.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.unhex(F.concat_ws("", F.transform("p", lambda x: F.hex(x.ids)))).alias("ids"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x.length).alias("n_tokens"),
        F.size("p").alias("n_pieces"),
    )


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_pieces(tokenize_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
