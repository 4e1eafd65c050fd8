"""Byte-level functions as built-in column expressions, and crc32c over Arrow batches.

Everything but crc32c stays inside the JVM; Spark has no crc32c, so that one runs on whole batches with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sediment.functions import codec


def byte_at(data: Column, k: Column) -> Column:
    """The k-th byte (from 0) as a number, null beyond the end."""
    return F.when(k < F.octet_length(data), F.conv(F.hex(F.substring(data, k + 1, F.lit(1))), 16, 10).cast("int"))


def one_byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def prefix_of(data: Column, n: Column) -> Column:
    return F.substring(data, F.lit(1), n)


def common_prefix(a: Column, b: Column) -> Column:
    """How many first bytes two keys share."""
    differs = lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))
    least = F.least(F.octet_length(a), F.octet_length(b))
    first = F.array_min(F.filter(F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")), differs))
    return F.coalesce(first - 1, least).cast("long")


def successor(key: Column) -> Column:
    """The shortest key that is not below `key`."""
    n = F.octet_length(key)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    free = F.get(F.filter(places, lambda k: byte_at(key, k) < 255), F.lit(0))
    return F.when(free.isNull(), key).otherwise(F.concat(prefix_of(key, free), one_byte(byte_at(key, free) + 1)))


def separator(low: Column, high: Column) -> Column:
    """The shortest key s with low <= s < high, for low < high."""
    k = common_prefix(low, high).cast("int")
    n = F.octet_length(low)
    raised = lambda at: F.concat(prefix_of(low, at), one_byte(byte_at(low, at) + 1))
    places = F.when(n > k + 1, F.sequence(k + 1, n - 1)).otherwise(F.array().cast("array<int>"))
    free = F.get(F.filter(places, lambda j: byte_at(low, j) < 255), F.lit(0))
    roomy = (byte_at(low, k) + 1 < byte_at(high, k)) | (k + 1 < F.octet_length(high))
    return F.when(k == n, low).when(roomy, raised(k)).when(free.isNotNull(), raised(free)).otherwise(low)


def put_varint(n: Column) -> Column:
    """A number from 0 to 2^63 - 1 in base 128, low groups first, a set high bit on all but the last."""
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
    parts = [F.when(groups > k, F.lpad(F.hex(_group(n, k) + F.when(groups > k + 1, 128).otherwise(0)), 2, "0")).otherwise("") for k in range(9)]
    return F.unhex(F.concat(*parts))


def _group(n: Column, k: int) -> Column:
    return F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))


def get_varint(data: Column) -> Column:
    """The number that a binary column holds in base 128; null if it is cut or too long."""
    value = sum((F.coalesce(byte_at(data, F.lit(k)).bitwiseAND(F.lit(127)).cast("long"), F.lit(0)) * F.lit(1 << 7 * k) for k in range(9)), F.lit(0).cast("long"))
    n = F.octet_length(data)
    return F.when((n > 0) & (n <= 9) & (byte_at(data, n - 1) < 128), value)


def prefixed(data: Column) -> Column:
    """Bytes behind their length."""
    return F.concat(put_varint(F.octet_length(data).cast("long")), data)


def pack_tag(seq: Column, kind: Column) -> Column:
    return (seq.cast("decimal(20,0)") * 256 + kind).cast("decimal(20,0)")


def crc_of_rows(rows: list[bytes]) -> np.ndarray:
    """crc32c of each value: all values advance together, a byte a step, aligned at their ends."""
    if not rows:
        return np.zeros(0, np.int64)
    size = np.array([len(r) for r in rows])
    out = np.zeros(len(rows), np.uint32)
    steps = np.array(codec._CRC, np.uint32)
    order = np.argsort(size, kind="stable")
    for part in np.array_split(order, max(1, len(rows) * int(size.max()) // (1 << 24))):  # 16 MB at a time
        width = int(size[part].max(initial=0))
        table = np.frombuffer(b"".join(rows[i].rjust(width, b"\0") for i in part.tolist()), np.uint8).reshape(len(part), width)
        state = np.zeros(len(part), np.uint32)
        for column in np.ascontiguousarray(table.T):
            state = state >> np.uint32(8) ^ steps[(state ^ column) & np.uint32(255)]
        begun = {n: codec.crc_shift(0xFFFFFFFF, n) for n in np.unique(size[part]).tolist()}
        out[part] = state ^ np.array([begun[n] for n in size[part].tolist()], np.uint32) ^ np.uint32(0xFFFFFFFF)
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def crc32c(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """crc32c of each binary value; of null, that of no bytes."""
    for values in batches:
        yield pd.Series(crc_of_rows([b"" if v is None else bytes(v) for v in values]))


def mask_crc(crc: Column) -> Column:
    """The stored form of a checksum: turned right by 15 bits, plus a constant."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (turned + F.lit(codec.MASK_DELTA)) % F.lit(1 << 32)
