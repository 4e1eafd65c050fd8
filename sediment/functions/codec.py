"""Byte-level formats of sorted-table databases: integers, checksums, filters, log records, batches, edits and tables.

Plain Python over bytes, for interchange files; Spark's own storage is Parquet. Decoders raise
Corrupt with the offset of the trouble.
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from sediment.operators.log import DELETE, MAX_SEQ, PUT

# Fixed values of the formats.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
TABLE_MAGIC = 0xDB4775248B80FB57
BLOOM_SEED, BLOOM_MULTIPLIER = 0xBC9F1D34, 0xC6A4A793
LOG_BLOCK, LOG_HEADER = 32768, 7
ZERO, FULL, FIRST, MIDDLE, LAST = range(5)
FILTER_BASE_LG = 11
#: codec id: name, in the two common assignments.
GOOGLE_CODECS = {0: "none", 1: "snappy", 2: "zstd"}
MOJANG_CODECS = {0: "none", 2: "zlib", 4: "raw_zlib"}


class Corrupt(ValueError):
    def __init__(self, what: str, offset: int = -1):
        super().__init__(f"{what} at {offset}" if offset >= 0 else what)
        self.what, self.offset = what, offset


# integers


def put_varint(n: int, bits: int = 64) -> bytes:
    if not 0 <= n < 1 << bits:
        raise ValueError(f"{n} does not fit {bits} bits")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, position after it)."""
    value = shift = 0
    start = at
    while True:
        if at >= len(data):
            raise Corrupt("truncated varint", start)
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            break
        shift += 7
        if shift >= bits:
            raise Corrupt("varint too long", start)
    if value >= 1 << bits:
        raise Corrupt("varint too large", start)
    return value, at


def put_prefixed(data: bytes) -> bytes:
    return put_varint(len(data), 32) + data


def get_prefixed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = get_varint(data, at, 32)
    if at + n > len(data):
        raise Corrupt("truncated bytes", at)
    return data[at : at + n], at + n


# keys


def pack_tag(seq: int, kind: int) -> int:
    return seq << 8 | kind


def unpack_tag(tag: int) -> tuple[int, int]:
    return tag >> 8, tag & 255


def internal_key(key: bytes, seq: int, kind: int) -> bytes:
    return key + struct.pack("<Q", pack_tag(seq, kind))


def split_internal(key: bytes) -> tuple[bytes, int, int]:
    if len(key) < 8:
        raise Corrupt("internal key shorter than its tag")
    seq, kind = unpack_tag(struct.unpack("<Q", key[-8:])[0])
    if kind not in (DELETE, PUT):
        raise Corrupt(f"unknown entry type {kind}")
    return key[:-8], seq, kind


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def separator(low: bytes, high: bytes) -> bytes:
    """The shortest key s with low <= s < high (low < high), by raising a byte of `low` and cutting what follows."""
    k = common_prefix(low, high)
    if k == len(low):  # low is a prefix of high
        return low
    if low[k] + 1 < high[k] or k + 1 < len(high):  # the raised byte stays below high, or high goes on behind it
        return low[:k] + bytes([low[k] + 1])
    for j in range(k + 1, len(low)):  # room is only behind byte k
        if low[j] < 255:
            return low[:j] + bytes([low[j] + 1])
    return low


def internal_separator(low: bytes, high: bytes) -> bytes:
    """A short internal key from `low` on and before `high` (both with tags): a shorter user key gets the largest tag."""
    user = split_internal(low)[0]
    other = split_internal(high)[0]
    short = separator(user, other) if user < other else user
    return low if len(short) >= len(user) else internal_key(short, MAX_SEQ + 1, PUT)


def internal_successor(key: bytes) -> bytes:
    """A short internal key not before `key`."""
    user = split_internal(key)[0]
    short = successor(user)
    return key if len(short) >= len(user) else internal_key(short, MAX_SEQ + 1, PUT)


def successor(key: bytes) -> bytes:
    """A short key not below `key`; a key of ff bytes is its own."""
    for k, byte in enumerate(key):
        if byte < 255:
            return key[:k] + bytes([byte + 1])
    return key


# checksums


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CRC32C_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()


def _plain_crc(data: bytes, state: int) -> int:
    for byte in data:
        state = state >> 8 ^ _CRC[(state ^ byte) & 255]
    return state


_zeros: dict[int, np.ndarray] = {}


def _times(columns: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The image of each state under a linear map that is given by the images of the 32 bits."""
    out = np.zeros_like(state)
    for k in range(32):
        out ^= np.where(state >> np.uint32(k) & np.uint32(1), columns[k], np.uint32(0))
    return out


def _after_zeros(power: int) -> np.ndarray:
    """The map that 2^power zero bytes make of a state."""
    if power not in _zeros:
        if power:
            half = _after_zeros(power - 1)
            _zeros[power] = _times(half, half)
        else:
            _zeros[0] = np.array([_plain_crc(b"\0", 1 << k) for k in range(32)], np.uint32)
    return _zeros[power]


def crc_shift(state: int, n: int) -> int:
    """The state after n zero bytes."""
    at = np.array([state], np.uint32)
    for power in range(n.bit_length()):
        if n >> power & 1:
            at = _times(_after_zeros(power), at)
    return int(at[0])


def crc_raw(data: bytes) -> int:
    """The state that `data` makes of state 0. States are linear: crc_raw(a + b) is crc_shift(crc_raw(a), len(b)) ^ crc_raw(b), so parts can be done apart."""
    if len(data) < 8192:
        return _plain_crc(data, 0)
    power = min(10, len(data).bit_length() // 2)  # the data as rows of 2^power bytes, advanced together column by column
    width = 1 << power
    rows = 1 << (-(-len(data) // width) - 1).bit_length()
    table = np.zeros(rows * width, np.uint8)
    table[len(table) - len(data) :] = np.frombuffer(data, np.uint8)  # zeros before it don't change state 0
    columns = np.ascontiguousarray(table.reshape(rows, width).T)
    steps, state = np.array(_CRC, np.uint32), np.zeros(rows, np.uint32)
    for column in columns:
        state = state >> np.uint32(8) ^ steps[(state ^ column) & np.uint32(255)]
    while len(state) > 1:
        state = _times(_after_zeros(power), state[::2]) ^ state[1::2]
        power += 1
    return int(state[0])


def crc32c(data: bytes, crc: int = 0) -> int:
    if len(data) < 8192:
        return _plain_crc(data, crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return crc_shift(crc ^ 0xFFFFFFFF, len(data)) ^ crc_raw(data) ^ 0xFFFFFFFF


def mask_crc(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def unmask_crc(masked: int) -> int:
    rot = (masked - MASK_DELTA) & 0xFFFFFFFF
    return (rot >> 17 | rot << 15) & 0xFFFFFFFF


# Bloom filters


def bloom_hash(data: bytes) -> int:
    h = (BLOOM_SEED ^ len(data) * BLOOM_MULTIPLIER) & 0xFFFFFFFF
    whole = len(data) // 4 * 4
    for (word,) in struct.iter_unpack("<I", data[:whole]):
        h = (h + word) * BLOOM_MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 16
    tail = data[whole:]
    if tail:
        h = (h + int.from_bytes(tail, "little")) * BLOOM_MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 24
    return h


def _bloom_bits(key: bytes, hashes: int, bits: int) -> Iterator[int]:
    h = bloom_hash(key)
    step = (h >> 17 | h << 15) & 0xFFFFFFFF
    for _ in range(hashes):
        yield h % bits
        h = (h + step) & 0xFFFFFFFF


def bloom_build(keys: list[bytes], bits_per_key: int = 10) -> bytes:
    """A filter over `keys`, the empty key included; without keys the filter is empty and matches nothing."""
    if not keys:
        return b""
    hashes = max(1, int(bits_per_key * math.log(2)))
    if hashes > 30:  # larger numbers are reserved
        hashes, bits_per_key = 30, 43
    size = (max(64, len(keys) * bits_per_key) + 7) // 8
    out = bytearray(size)
    for key in keys:
        for bit in _bloom_bits(key, hashes, size * 8):
            out[bit >> 3] |= 1 << (bit & 7)
    return bytes(out) + bytes([hashes])


def bloom_match(filter_: bytes, key: bytes) -> bool:
    if len(filter_) < 2:
        return False
    hashes = filter_[-1]
    if hashes > 30:  # reserved for other encodings: cannot rule anything out
        return True
    bits = (len(filter_) - 1) * 8
    return all(filter_[bit >> 3] >> (bit & 7) & 1 for bit in _bloom_bits(key, hashes, bits))


# log files


def log_write(records: list[bytes], block: int = LOG_BLOCK) -> bytes:
    out = bytearray()
    for record in records:
        at, begun = 0, False
        while True:
            room = block - len(out) % block
            if room < LOG_HEADER:
                out += bytes(room)
                room = block
            take = record[at : at + room - LOG_HEADER]
            at += len(take)
            ends = at == len(record)
            kind = (LAST if begun else FULL) if ends else (MIDDLE if begun else FIRST)
            out += struct.pack("<IHB", mask_crc(crc32c(bytes([kind]) + take)), len(take), kind) + take
            begun = True
            if ends:
                break
    return bytes(out)


def log_read(data: bytes, block: int = LOG_BLOCK, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, None) or (offset, None, problem); reading goes on at the next record or block after a problem.

    Reading begins at `start`; with `stop` it ends before the first record that starts at or after it.
    """
    at, parts, begin = start, None, 0
    while at < len(data):
        left = block - at % block
        if left < LOG_HEADER:
            at += left
            continue
        if at + LOG_HEADER > len(data):
            yield at, None, "truncated header"
            return
        crc, n, kind = struct.unpack_from("<IHB", data, at)
        if kind == ZERO and n == 0:
            at += left
            continue
        if n > left - LOG_HEADER:
            yield at, None, "record longer than its block"
            parts, at = None, at + left
            continue
        if at + LOG_HEADER + n > len(data):
            yield at, None, "truncated record"
            return
        body = data[at + LOG_HEADER : at + LOG_HEADER + n]
        if unmask_crc(crc) != crc32c(bytes([kind]) + body):
            yield at, None, "checksum"
            parts, at = None, at + left
            continue
        if kind in (FULL, FIRST):
            if parts is not None:
                yield begin, None, "record without its end"
            if stop is not None and at >= stop:
                return
            begin, parts = at, [body]
        elif parts is None:
            yield at, None, "record without its start"
        elif kind in (MIDDLE, LAST):
            parts.append(body)
        else:
            yield at, None, f"record type {kind}"
            parts = None
        if kind in (FULL, LAST) and parts is not None:
            yield begin, b"".join(parts), None
            parts = None
        at += LOG_HEADER + n
    if parts is not None:
        yield begin, None, "truncated record"


def log_first(data: bytes, block: int = LOG_BLOCK) -> int | None:
    """The offset of the first sound start of a record, or None."""
    at = 0
    while at + LOG_HEADER <= len(data):
        left = block - at % block
        if left < LOG_HEADER:
            at += left
            continue
        crc, n, kind = struct.unpack_from("<IHB", data, at)
        body = data[at + LOG_HEADER : at + LOG_HEADER + n]
        if kind == ZERO and n == 0 or n > left - LOG_HEADER or len(body) < n or unmask_crc(crc) != crc32c(bytes([kind]) + body):
            at += left
        elif kind in (FULL, FIRST):
            return at
        else:
            at += LOG_HEADER + n
    return None


def log_part(read, size: int, start: int, stop: int, block: int = LOG_BLOCK) -> Iterator[tuple[int, bytes | None, str | None]]:
    """What log_read gives of the part [start, stop) of a log of `size` bytes, both multiples of a block: from the first record that starts in it (from 0, if start is 0)
    up to the first that starts at or after stop. Parts of a log make up the whole. read(at, end) gives bytes."""
    end = min(size, stop)
    data = read(start, end)
    first = 0 if start == 0 else log_first(data, block)
    if first is None:
        return
    step = block
    while end < size and log_first(data[stop - start :], block) is None:  # up to where the next part begins
        data, end, step = data + read(end, min(size, end + step)), min(size, end + step), 2 * step
    yield from ((at + start, record, problem) for at, record, problem in log_read(data, block, first, stop - start))


# write batches


def batch_encode(first_seq: int, ops: list[tuple[int, bytes, bytes | None]]) -> bytes:
    out = bytearray(struct.pack("<QI", first_seq, len(ops)))
    for kind, key, value in ops:
        out += bytes([kind]) + put_prefixed(key)
        if kind == PUT:
            out += put_prefixed(value or b"")
    return bytes(out)


def batch_decode(data: bytes) -> list[tuple[bytes, int, int, bytes | None]]:
    """(key, seq, kind, value) of each operation."""
    if len(data) < 12:
        raise Corrupt("batch header")
    seq, n = struct.unpack_from("<QI", data)
    at, out = 12, []
    while at < len(data):
        kind = data[at]
        if kind not in (DELETE, PUT):
            raise Corrupt("unknown type", at)
        key, at = get_prefixed(data, at + 1)
        value, at = get_prefixed(data, at) if kind == PUT else (None, at)
        if len(out) == n:
            raise Corrupt("too many entries", at)
        out.append((key, seq + len(out), kind, value))
    if len(out) < n:
        raise Corrupt("too few entries", at)
    if out and not 0 < out[0][1] <= out[-1][1] <= MAX_SEQ:
        raise Corrupt("sequence number")
    return out


# version edits

_TAGS = {1: "comparator", 2: "log_number", 3: "next_file_number", 4: "last_sequence", 5: "compaction_pointers", 6: "deleted", 7: "added", 9: "prev_log_number"}


def edit_encode(edit: dict) -> bytes:
    out = bytearray()
    for tag, name in _TAGS.items():
        value = edit.get(name)
        if value is None:
            continue
        if name == "comparator":
            out += put_varint(tag) + put_prefixed(value)
        elif name == "compaction_pointers":
            for level, key in value:
                out += put_varint(tag) + put_varint(level) + put_prefixed(key)
        elif name == "deleted":
            for level, number in value:
                out += put_varint(tag) + put_varint(level) + put_varint(number)
        elif name == "added":
            for level, number, size, low, high in value:
                out += put_varint(tag) + put_varint(level) + put_varint(number) + put_varint(size) + put_prefixed(low) + put_prefixed(high)
        else:
            out += put_varint(tag) + put_varint(value)
    return bytes(out)


def edit_decode(data: bytes) -> dict:
    out: dict = {"compaction_pointers": [], "deleted": [], "added": []}
    at = 0
    while at < len(data):
        tag, at = get_varint(data, at, 32)
        name = _TAGS.get(tag)
        if name is None:
            raise Corrupt(f"edit tag {tag}", at)
        if name == "comparator":
            out[name], at = get_prefixed(data, at)
        elif name in ("compaction_pointers", "deleted", "added"):
            level, at = get_varint(data, at, 32)
            if level > 6:
                raise Corrupt("level", at)
            if name == "compaction_pointers":
                key, at = get_prefixed(data, at)
                out[name].append((level, key))
                continue
            number, at = get_varint(data, at)
            if name == "deleted":
                out[name].append((level, number))
                continue
            size, at = get_varint(data, at)
            low, at = get_prefixed(data, at)
            high, at = get_prefixed(data, at)
            out[name].append((level, number, size, low, high))
        else:
            out[name], at = get_varint(data, at)
    return out


# tables


def compress(data: bytes, codec: str) -> bytes:
    if codec == "snappy":
        import pyarrow as pa

        return pa.compress(data, codec="snappy", asbytes=True)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if codec == "zlib":
        return zlib.compress(data)
    if codec == "raw_zlib":
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()
    return data


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "snappy":
        import pyarrow as pa

        size, _ = get_varint(data, 0, 32)
        return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "raw_zlib":
        return zlib.decompress(data, -15)
    if codec != "none":
        raise Corrupt(f"codec {codec}")
    return data


def block_encode(entries: list[tuple[bytes, bytes]], restart: int = 16) -> bytes:
    out, starts, last = bytearray(), [], b""
    for k, (key, value) in enumerate(entries):
        shared = 0
        if k % restart == 0:
            starts.append(len(out))
        else:
            shared = common_prefix(last, key)
        out += put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:] + value
        last = key
    starts = starts or [0]
    return bytes(out) + struct.pack(f"<{len(starts) + 1}I", *starts, len(starts))


def block_decode(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(data) < 4:
        raise Corrupt("block")
    (n,) = struct.unpack_from("<I", data, len(data) - 4)
    end = len(data) - 4 * (n + 1)
    if end < 0:
        raise Corrupt("restart array")
    at, key = 0, b""
    while at < end:
        shared, at = get_varint(data, at, 32)
        own, at = get_varint(data, at, 32)
        size, at = get_varint(data, at, 32)
        if shared > len(key) or at + own + size > end:
            raise Corrupt("block entry", at)
        key = key[:shared] + data[at : at + own]
        yield key, data[at + own : at + own + size]
        at += own + size


def block_seek(data: bytes, target: bytes, less) -> list[tuple[bytes, bytes]]:
    """Entries from the last restart point whose key is less than `target` on (or the first): what a search has to look through."""
    (n,) = struct.unpack_from("<I", data, len(data) - 4)
    end = len(data) - 4 * (n + 1)
    if end < 0:
        raise Corrupt("restart array")
    starts = struct.unpack_from(f"<{n}I", data, end)
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        _, at = get_varint(data, starts[mid], 32)
        own, at = get_varint(data, at, 32)
        _, at = get_varint(data, at, 32)
        low, high = (mid, high) if less(data[at : at + own], target) else (low, mid - 1)
    begin = starts[low] if n else 0
    return list(block_decode(data[begin:end] + struct.pack("<II", 0, 1)))


def handle(offset: int, size: int) -> bytes:
    return put_varint(offset) + put_varint(size)


def table_write(entries: list[tuple[bytes, int, int, bytes | None]], block_size: int = 4096, codec: str = "none", codecs: dict[int, str] = GOOGLE_CODECS, bits_per_key: int | None = 10, least_gain: int = 32) -> bytes:
    """A table file of (key, seq, kind, value) entries in internal order.

    A block stays compressed only if that saves least_gain/256 of it, and is tagged with what it is.
    """
    code = {name: k for k, name in codecs.items()}[codec]
    out = bytearray()
    filters: list[list[bytes]] = []

    def add_block(raw: bytes) -> bytes:
        packed, kind = compress(raw, codec), code
        if len(packed) > len(raw) - len(raw) * least_gain // 256:
            packed, kind = raw, 0
        at = len(out)
        body = packed + bytes([kind])
        out.extend(body + struct.pack("<I", mask_crc(crc32c(body))))
        return handle(at, len(packed))

    index, pending, size, held = [], [], 0, []
    keys = [internal_key(k, s, t) for k, s, t, _ in entries]

    def close(following: bytes | None) -> None:
        nonlocal pending, size, held
        if bits_per_key is not None:
            chunk = len(out) >> FILTER_BASE_LG
            while len(filters) <= chunk:
                filters.append([])
            filters[chunk] += held
        limit = internal_successor(pending[-1][0]) if following is None else internal_separator(pending[-1][0], following)
        index.append((limit, add_block(block_encode(pending))))
        pending, size, held = [], 0, []

    for k, (user, _, _, value) in enumerate(entries):
        pending.append((keys[k], value or b""))
        held.append(user)
        size += len(keys[k]) + len(value or b"") + 6
        if size >= block_size:
            close(keys[k + 1] if k + 1 < len(entries) else None)
    if pending:
        close(None)
    meta = []
    if bits_per_key is not None:
        body, starts = bytearray(), []
        for chunk in filters:
            starts.append(len(body))
            body += bloom_build(chunk, bits_per_key)
        starts.append(len(body))
        raw = bytes(body) + struct.pack(f"<{len(starts)}I", *starts) + bytes([FILTER_BASE_LG])
        at = len(out)
        out += raw + b"\0" + struct.pack("<I", mask_crc(crc32c(raw + b"\0")))
        meta.append((b"filter.leveldb.BuiltinBloomFilter2", handle(at, len(raw))))
    meta_at = add_block(block_encode(meta))
    index_at = add_block(block_encode(index, 1))
    out += (meta_at + index_at).ljust(40, b"\0") + struct.pack("<Q", TABLE_MAGIC)
    return bytes(out)


class Table:
    """Reader of a table file held in memory."""

    def __init__(self, data: bytes, codecs: dict[int, str] = GOOGLE_CODECS, verify: bool = True):
        if len(data) < 48 or struct.unpack_from("<Q", data, len(data) - 8)[0] != TABLE_MAGIC:
            raise Corrupt("footer", max(0, len(data) - 48))
        self.data, self.codecs, self.verify = data, codecs, verify
        footer = data[-48:]
        meta_at, at = get_varint(footer)
        meta_size, at = get_varint(footer, at)
        index_at, at = get_varint(footer, at)
        index_size, at = get_varint(footer, at)
        self.meta = dict(block_decode(self.block(meta_at, meta_size)))
        self.index = [(k, get_varint(h)[0], get_varint(h, get_varint(h)[1])[0]) for k, h in block_decode(self.block(index_at, index_size))]

    def block(self, at: int, size: int) -> bytes:
        body = self.data[at : at + size + 1]
        if at + size + 5 > len(self.data):
            raise Corrupt("block handle", at)
        if self.verify and unmask_crc(struct.unpack_from("<I", self.data, at + size + 1)[0]) != crc32c(body):
            raise Corrupt("block checksum", at)
        name = self.codecs.get(body[-1])
        if name is None:
            raise Corrupt(f"codec id {body[-1]}", at)
        return decompress(body[:-1], name)

    def entries(self, low: bytes | None = None, high: bytes | None = None) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        """(key, seq, kind, value) of user keys in [low, high); only blocks that can hold them are read."""
        for limit, at, size in self.index:
            if low is not None and limit[:-8] < low:
                continue
            for key, value in block_decode(self.block(at, size)):
                user, seq, kind = split_internal(key)
                if high is not None and user >= high:
                    return
                if low is None or user >= low:
                    yield user, seq, kind, value if kind == PUT else None

    def before(self, high: bytes | None = None) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        """Entries of user keys before `high` (default: all), from the last back to the first; blocks are read one at a time."""
        for k in range(len(self.index) - 1, -1, -1):
            if high is not None and k and self.index[k - 1][0][:-8] >= high:
                continue
            for key, value in reversed(list(block_decode(self.block(*self.index[k][1:])))):
                user, seq, kind = split_internal(key)
                if high is None or user < high:
                    yield user, seq, kind, value if kind == PUT else None

    def seek(self, low: bytes) -> tuple[bytes, int, int, bytes | None] | None:
        """The first entry at or after `low`: a search of the index, of the block's restart points, and through one run of entries."""
        ends = [limit[:-8] for limit, _, _ in self.index]
        for limit, at, size in self.index[bisect.bisect_left(ends, low) :]:
            for key, value in block_seek(self.block(at, size), low, lambda a, b: a[:-8] < b):
                user, seq, kind = split_internal(key)
                if user >= low:
                    return user, seq, kind, value if kind == PUT else None
        return None

    def seek_before(self, high: bytes) -> tuple[bytes, int, int, bytes | None] | None:
        """The last entry before `high`."""
        return next(self.before(high), None)

    def may_hold(self, key: bytes) -> bool:
        """Whether the filter lets a point lookup of `key` through."""
        place = self.meta.get(b"filter.leveldb.BuiltinBloomFilter2")
        found = next(((at, size) for limit, at, size in self.index if limit[:-8] >= key), None)
        if found is None:
            return False
        if place is None:
            return True
        at, after = get_varint(place)
        size, _ = get_varint(place, after)
        raw = self.data[at : at + size]
        (array_at,) = struct.unpack_from("<I", raw, len(raw) - 5)
        starts = struct.unpack_from(f"<{(len(raw) - 1 - array_at) // 4}I", raw, array_at)
        chunk = found[0] >> raw[-1]
        return chunk + 1 >= len(starts) or bloom_match(raw[starts[chunk] : starts[chunk + 1]], key)

    def get(self, key: bytes, as_of: int = MAX_SEQ) -> tuple[int, int, bytes | None] | None:
        """(seq, kind, value) of the newest version at or below `as_of`, deletes included."""
        if not self.may_hold(key):
            return None
        return next(((s, t, v) for k, s, t, v in self.entries(key, key + b"\0") if k == key and s <= as_of), None)

    def approximate_offset(self, key: bytes) -> int:
        return next((at for limit, at, _ in self.index if limit[:-8] >= key), max((at + size for _, at, size in self.index), default=0))


# file names


def parse_name(name: str) -> tuple[str, int | None] | None:
    """(kind, number) of a database file's name, or None for a foreign file."""
    if name in ("LOCK", "CURRENT", "LOG", "LOG.old"):
        return name, None
    stem, dot, ext = name.partition(".")
    if name.startswith("MANIFEST-") and name[9:].isascii() and name[9:].isdigit():
        return "MANIFEST", int(name[9:])
    kinds = {"ldb": "table", "sst": "table", "log": "log", "dbtmp": "temp"}
    if dot and ext in kinds and stem.isascii() and stem.isdigit():
        return kinds[ext], int(stem)
    return None


def format_name(kind: str, number: int | None = None) -> str:
    if kind == "MANIFEST":
        return f"MANIFEST-{number:06d}"
    ext = {"table": "ldb", "log": "log", "temp": "dbtmp"}.get(kind)
    return f"{number:06d}.{ext}" if ext else kind
