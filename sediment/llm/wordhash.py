"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes other than space and 09-0D, with A-Z lower-cased on request. A word's
hash is a polynomial over per-byte random values, finished with a 64-bit mixer; a shingle's
hash mixes five word hashes. All arithmetic wraps at 64 bits inside numpy, so there is no
Python work per word. Texts are taken in segments cut at white space: memory stays bounded
by the segment length (or the longest single word), not by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


_BYTE = _stream(256, 17)
_PLACE = _stream(8, 99) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        table = np.full(size, _BASE, np.uint64)
        table[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw[:0], bounds - bounds[0]


def words(column: pa.Array, lower: bool = True, prefixes: tuple[int, ...] = ()):
    """(document index, hash, start byte, length) of each word in order, and a hash per asked prefix length (in bytes)."""
    data, offsets = buffers(column)
    docs, hashes, starts, lengths, heads = [], [], [], [], [[] for _ in prefixes]
    doc_start = np.zeros(len(data) + 1, bool)
    doc_start[offsets] = True
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not (_SPACE[data[end - 1]] or doc_start[end]):
            step = data[end : end + SEGMENT]
            stop = np.flatnonzero(_SPACE[step] | doc_start[end : end + len(step)])
            end += int(stop[0]) + 1 if len(stop) else len(step)
            if len(stop) and doc_start[end - 1]:
                end -= 1
                break
        seg = data[at:end]
        text = ~_SPACE[seg]
        fresh = doc_start[at:end]
        before = np.empty_like(text)
        before[0], before[1:] = False, text[:-1]
        first = text & (~before | fresh)
        begin = np.flatnonzero(first)
        if len(begin):
            after = np.ones_like(text)
            after[:-1] = first[1:] | ~text[1:]
            stop = np.flatnonzero(text & after) + 1
            length = stop - begin
            low = _LOWER[seg] if lower else seg
            place = np.arange(len(seg), dtype=np.int32)
            place[begin[0] :] -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, len(seg))))
            with np.errstate(over="ignore"):
                powers = _power_table(int(place.max()) + 1)
                value = _BYTE[low] * powers[place]
                value[~text] = 0
                hashes.append(mix(np.add.reduceat(value, begin) + length.astype(np.uint64)))
                for k, p in enumerate(prefixes):
                    cut = np.where(place < p, value, np.uint64(0))
                    head = mix(np.add.reduceat(cut, begin) + np.uint64(1000 + p))
                    heads[k].append(np.where(length >= p, head, np.uint64(0)))
            starts.append(begin + at)
            lengths.append(length)
            docs.append(np.searchsorted(offsets, begin + at, "right") - 1)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    out = join(docs, np.int64), join(hashes, np.uint64), join(starts, np.int64), join(lengths, np.int64)
    return (*out, *[join(h, np.uint64) for h in heads]) if prefixes else out


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles of each text, ordered by document and hash.

    A text of one to width-1 words has one shingle, its whole word sequence; one without words has none.
    """
    doc, word, _, _ = words(column)
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = max(0, n - width + 1)
        whole = np.zeros(runs, np.uint64)
        for j in range(width):
            whole += word[j : j + runs] * _PLACE[j]
        inside = doc[:runs] == doc[width - 1 :] if runs else np.zeros(0, bool)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        count = np.diff(np.append(first, n))
        few = count < width
        short = np.zeros(few.sum(), np.uint64)
        for j in range(width - 1):
            has = count[few] > j
            short[has] += word[first[few][has] + j] * _PLACE[j]
        short += count[few].astype(np.uint64) * _PLACE[7]
        out_doc = np.concatenate([doc[:runs][inside], doc[first[few]]])
        out = mix(np.concatenate([whole[inside], short]))
        order = np.argsort(out_doc, kind="stable") if few.any() else slice(None)
    out_doc, out = out_doc[order], out[order]
    edges = np.append(np.flatnonzero(np.append(True, out_doc[1:] != out_doc[:-1])), len(out))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out[a:b].sort()
    keep = np.append(True, (out_doc[1:] != out_doc[:-1]) | (out[1:] != out[:-1]))
    return out_doc[keep], out[keep]
