"""Every registered core query against its SQL, random operation sequences against a dictionary model, codecs and sources."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sediment import queries
from sediment.functions import codec
from sediment.operators import log
from sediment.operators.batch import BatchError, WriteBatch
from sediment.plans import planner
from sediment.plans.store import ConflictError, Store, StoreError
from sediment.sources import formats

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "orders", "events", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name, tmp_path):
    queries.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    sql = queries.oracle_sql().get(name)
    if sql is None:
        return
    want = con.execute(sql).df()
    got = con.execute(f"select * from '{tmp_path}/out/*.parquet'").df()
    by = sorted(want.columns)
    assert sorted(got.columns) == by
    assert got[by].sort_values(by).astype(str).values.tolist() == want[by].sort_values(by).astype(str).values.tolist()


def test_store_against_a_dictionary(spark, tmp_path):
    rng, model, seen, pinned = random.Random(4), {}, {}, None
    with Store.open(spark, str(tmp_path / "db"), "key long, value string", create_if_missing=True) as store:
        for step in range(5):
            b = WriteBatch()
            for _ in range(rng.randint(1, 12)):
                k = rng.randrange(10)
                if rng.random() < 0.3:
                    b.delete(k)
                    model.pop(k, None)
                else:
                    b.put(k, f"{step}-{k}")
                    model[k] = f"{step}-{k}"
            seq = store.write(b)
            seen[seq] = dict(model)
            if step == 2:
                pinned = store.snapshot()
            if step in (3, 4):
                store.compact(step - 3)
        assert {r.key: r.value for r in store.scan().collect()} == model
        assert {r.key: r.value for r in store.scan(pinned).collect()} == seen[pinned]
        c, keys = store.cursor(), []
        while (row := c.next()) is not None:
            keys.append(row.key)
        assert keys == sorted(model) and not c.valid and c.prev().key == max(model) and c.seek_before(max(model)).key == sorted(model)[-2]
        assert store.get(next(iter(model))) == model[next(iter(model))] and store.get(99) is None
        store.release(pinned)
        assert store.oldest_snapshot() == store.last_sequence
        held = {f["file_number"] for f in store.files()}
        assert store.collect_garbage() and {f["file_number"] for f in store.files()} == held
        assert {r.key: r.value for r in store.scan().collect()} == model
        copy = store.checkpoint(str(tmp_path / "copy"))
        assert {r.key: r.value for r in copy.scan().collect()} == model
        copy.write(WriteBatch().put(3, "three").delete(4))
        copy.write(WriteBatch().put(3, "drei"))
        assert copy.compact_range(2, 5) + copy.compact_range() >= 1
        expect = {k: v for k, v in model.items() if k != 4} | {3: "drei"}
        assert {r.key: r.value for r in copy.scan().collect()} == expect
        copy.collect_garbage()
        assert {r.key: r.value for r in Store.repair(spark, str(tmp_path / "copy"), "key long, value string").scan().collect()} == expect
        other = Store.open(spark, str(tmp_path / "db"))
        other.put(1, "x")
        with pytest.raises(ConflictError):
            store.put(1, "y")
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "db"), comparator="other")
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "db"), error_if_exists=True)
    (tmp_path / "db" / "foreign.txt").write_text("x")
    Store.destroy(spark, str(tmp_path / "db"))
    assert [p.name for p in (tmp_path / "db").iterdir()] == ["foreign.txt"]


def test_batches():
    b = WriteBatch().put(b"a", b"1").delete(b"a")
    assert len(b) == 2 and [op[0] for op in b.push_batch(WriteBatch().put(b"", b""))] == [1, 0, 1]
    b.clear()
    assert len(b) == 0
    assert isinstance(BatchError("x"), ValueError)


def test_integers_and_keys():
    for n in (0, 1, 127, 128, 300, 2**32 - 1, 2**64 - 1):
        assert codec.get_varint(codec.put_varint(n)) == (n, len(codec.put_varint(n)))
    assert codec.put_varint(300) == b"\xac\x02"
    for bad in (b"\x80", b"\xff" * 11):
        with pytest.raises(codec.Corrupt):
            codec.get_varint(bad)
    assert codec.unpack_tag(codec.pack_tag(2**56 - 2, 1)) == (2**56 - 2, 1)
    rng = random.Random(2)
    for _ in range(2000):
        a, b = sorted(bytes(rng.choice(b"\x00\x01\x7f\x80\xfe\xff") for _ in range(rng.randint(0, 4))) for _ in range(2))
        if a < b:
            s = codec.separator(a, b)
            assert a <= s < b and len(s) <= max(1, len(a))
        assert codec.successor(a) >= a
    assert codec.separator(b"abcdefg", b"abzz") == b"abd" and codec.successor(b"\xff\xffab") == b"\xff\xffb" and codec.common_prefix(b"abc", b"abd") == 2


def test_checksums_and_filters():
    assert codec.crc32c(b"123456789") == 0xE3069283 and codec.crc32c(bytes(32)) == 0x8A9136AA
    assert codec.unmask_crc(codec.mask_crc(0x12345678)) == 0x12345678
    keys = [b"", *(b"k%d" % k for k in range(500))]
    bloom = codec.bloom_build(keys)
    assert all(codec.bloom_match(bloom, k) for k in keys)
    assert sum(codec.bloom_match(bloom, b"other%d" % k) for k in range(2000)) < 80
    assert not codec.bloom_match(codec.bloom_build([]), b"")


@pytest.mark.parametrize("trailer", range(0, 8))
def test_log_blocks(trailer):
    fill = codec.LOG_BLOCK - codec.LOG_HEADER - trailer
    records = [b"a" * fill, b"", b"b" * 100_000, b"c"]
    data = codec.log_write(records)
    assert [(r, p) for _, r, p in codec.log_read(data)] == [(r, None) for r in records]
    cut = list(codec.log_read(data[:-3]))
    assert [r for _, r, p in cut if p is None] == records[:3] and cut[-1][2].startswith("truncated")
    hurt = bytearray(data)
    hurt[20] ^= 1
    assert [r for _, r, p in codec.log_read(bytes(hurt)) if p is None][-1] == b"c"


def test_batch_and_edit_encoding():
    ops = [(1, b"k", b"v"), (0, b"", None), (1, b"\xff", b"")]
    data = codec.batch_encode(7, ops)
    assert codec.batch_decode(data) == [(b"k", 7, 1, b"v"), (b"", 8, 0, None), (b"\xff", 9, 1, b"")]
    for bad in (data[:8] + b"\x02" + data[9:], data[:8] + b"\x04" + data[9:], data[:12] + b"\x07" + data[13:], data[:-1], codec.batch_encode(0, ops), codec.batch_encode(2**56 - 3, ops)):
        with pytest.raises(codec.Corrupt):
            codec.batch_decode(bad)
    edit = {"comparator": b"c", "log_number": 3, "prev_log_number": 0, "next_file_number": 9, "last_sequence": 2**50, "compaction_pointers": [(2, b"p")], "deleted": [(1, 4)], "added": [(6, 8, 1000, b"a", b"z")]}
    assert codec.edit_decode(codec.edit_encode(edit)) == edit
    with pytest.raises(codec.Corrupt):
        codec.edit_decode(b"\x08")


@pytest.mark.parametrize("name,codecs", [("none", codec.GOOGLE_CODECS), ("snappy", codec.GOOGLE_CODECS), ("zstd", codec.GOOGLE_CODECS), ("zlib", codec.MOJANG_CODECS), ("raw_zlib", codec.MOJANG_CODECS)])
def test_tables(name, codecs):
    entries = [(b"%05d" % (k // 2), 10 - k % 2, 1 - (k % 5 == 0), None if k % 5 == 0 else b"value %d" % k * 3) for k in range(900)]
    table = codec.Table(codec.table_write([(b"", 5, 1, b"e"), *entries], block_size=512, codec=name, codecs=codecs), codecs)
    assert list(table.entries()) == [(b"", 5, 1, b"e"), *entries]
    assert [e[0] for e in table.entries(b"00100", b"00102")] == [b"00100"] * 2 + [b"00101"] * 2
    assert table.get(b"") == (5, 1, b"e") and table.get(b"00007")[0] == 10 and table.get(b"00007", 9)[0] == 9 and table.get(b"zzz") is None
    offsets = [table.approximate_offset(b"%05d" % k) for k in range(0, 450, 50)]
    assert offsets == sorted(offsets) and offsets[-1] > 0
    data = bytearray(table.data)
    data[3] ^= 64
    with pytest.raises(codec.Corrupt):
        list(codec.Table(bytes(data), codecs).entries())


def test_file_names():
    for kind, n in (("table", 7), ("log", 123456789), ("temp", 1), ("MANIFEST", 5), ("LOCK", None), ("CURRENT", None), ("LOG", None), ("LOG.old", None)):
        assert codec.parse_name(codec.format_name(kind, n)) == (kind, n)
    assert codec.parse_name("000012.sst") == ("table", 12)
    for bad in ("+12.log", "x.ldb", "12.foo", "MANIFEST-", "MANIFEST-+1", "12"):
        assert codec.parse_name(bad) is None


def test_resolution_edges(spark):
    rows = [(b"", 1, 1, b""), (b"a", 2, 1, b"x"), (b"a", 3, 0, None), (b"a", 5, 1, b"y"), (b"gone", 4, 0, None), (b"\x80", 6, 1, b"z"), (b"a\x00", 7, 1, b"p"), (b"\x7f", 8, 1, b"q")]
    changes = spark.createDataFrame(rows, "key binary, seq long, kind tinyint, value binary")
    live = [bytes(r.key) for r in log.resolve(changes).orderBy("key").collect()]
    assert live == [b"", b"a", b"a\x00", b"\x7f", b"\x80"]
    assert [bytes(r.key) for r in log.resolve(changes, 3).collect()] == [b""]
    assert [bytes(r.value) for r in log.resolve(changes, 2).filter("key = X'61'").collect()] == [b"x"]
    assert [r.age for r in log.history(changes, b"a").collect()] == [1, 2, 3]
    assert log.resolve(changes.limit(0)).count() == 0


def test_log_parts_make_up_the_whole():
    rng = random.Random(4)
    block = 64
    whole = codec.log_write([rng.randbytes(rng.choice((0, 5, 30, 57, 58, 200))) for _ in range(300)], block) + bytes(40)
    whole += bytes(-len(whole) % block) + codec.log_write([b"after zeros", b"x" * 500], block)
    for hurt in range(30):
        data = bytearray(whole)
        for _ in range(hurt):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        data = bytes(data[: len(data) - hurt * 3])
        want = list(codec.log_read(data, block))
        for step in (1, 2, 7):
            cuts = range(0, len(data), step * block)
            assert [x for at in cuts for x in codec.log_part(lambda a, b: data[a:b], len(data), at, at + step * block, block)] == want


def test_long_manifest_is_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    n = F.col("id")
    edits = spark.range(30_000).select(n.alias("edit_id"), F.when(n % 3 == 0, n).alias("log_number"), F.array(F.struct((n % 7).cast("int").alias("level"), n.alias("file_number"))).alias("deleted"))
    stream = type(edits).toLocalIterator
    monkeypatch.setattr(type(edits), "toLocalIterator", lambda *_, **__: pytest.fail("edits reach the driver"))
    formats.write_manifest(edits.repartition(7), str(tmp_path))
    monkeypatch.setattr(type(edits), "toLocalIterator", stream)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["MANIFEST-000002"]
    parts = formats.manifest_parts(spark, formats.located(spark, str(tmp_path)), 1 << 16)
    assert len(parts) > 3
    for read in (formats.load(spark, "manifest", str(tmp_path), mode="FAILFAST"), formats.load(spark, "manifest", str(tmp_path), mode="FAILFAST", parts=json.dumps(parts))):
        got = sorted((r.edit_id, r.log_number, r.deleted[0].file_number) for r in read.collect())
        assert got == [(k, k if k % 3 == 0 else None, k) for k in range(30_000)]


def test_a_span_names_few_blocks(spark):
    rng = random.Random(6)
    spans = [tuple(sorted(rng.choices(range(3000), k=2))) for _ in range(200)] + [(1, (1 << 23) - 2), (0, 0), (15, 16), (16, 31)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", planner._pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        assert len(r.p) <= 30 * planner.TIERS
        assert sum(1 << planner.FAN_BITS * p.tier for p in r.p) == r.b - r.a + 1
        if r.b < 3000:
            assert sorted(k for p in r.p for k in range(p.block << planner.FAN_BITS * p.tier, p.block + 1 << planner.FAN_BITS * p.tier)) == list(range(r.a, r.b + 1))
