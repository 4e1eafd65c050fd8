"""The store: typed keys, settled scans, bounded compaction, late and repeated batches, damage, and foreign database folders."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import codec
from sediment.operators import log
from sediment.operators.checksum import ordered_checksum
from sediment.plans import planner
from sediment.plans import store as store_module
from sediment.plans.planner import Limits
from sediment.plans.store import ConflictError, Store, StoreError
from sediment.sources import formats
from sediment.streaming.apply import apply_log_stream

TINY = Limits(l0_files=2, base_bytes=4_000, file_bytes=3_000, grandparent_bytes=6_000, expand_bytes=20_000)
KEYS = {
    "binary": [bytes([0, k]) if k % 2 else bytes([200, k]) for k in range(40)],
    "date": [datetime.date(1999, 12, 1) + datetime.timedelta(days=9 * k) for k in range(40)],
    "decimal(12,2)": [decimal.Decimal(k * k * 7 - 900) / 100 for k in range(40)],
    "timestamp_ntz": [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k * 1_234_567.5) for k in range(40)],
    "string": [f"é{k}" if k % 3 else f"Z{k}" for k in range(40)],
    "double": [(k - 20) * 1.7e3 for k in range(40)],
}


def changes(spark, rows, key="long", value="string"):
    return spark.createDataFrame(rows, f"key {key}, seq long, kind tinyint, value {value}")


def live(store, as_of=None):
    return {r.key: r.value for r in store.scan(as_of).collect()}


@pytest.mark.parametrize("kind", KEYS)
def test_keys_of_every_type(spark, tmp_path, kind):
    keys = KEYS[kind]
    with Store.open(spark, str(tmp_path / "db"), f"key {kind}, value long", create_if_missing=True, limits=TINY) as store:
        for part in (0, 1):
            store.write_log(changes(spark, [(k, n + 1 + 100 * part, 1, n + part) for n, k in enumerate(keys) if n % 2 >= part], kind, "long"), sealed=1000)
        store.compact_range()
        want = {k: n + (n % 2) for n, k in enumerate(keys)}
        plain = (lambda x: bytes(x)) if kind == "binary" else (lambda x: x)
        assert {plain(r.key): r.value for r in store.scan().collect()} == want
        assert all(store.get(k) == v for k, v in list(want.items())[::13])
        low, high = sorted(keys)[10], sorted(keys)[20]
        assert {plain(r.key) for r in store.scan(low=low, high=high).collect()} == {k for k in keys if low <= k <= high}
        assert 0 < store.approximate_size(low, high) <= sum(f["file_size"] for f in store.files())
        again = Store.open(spark, str(tmp_path / "db"))
        assert again.files() == store.files() and {f["level"] for f in again.files()} == {1}
        assert [r.key for r in again.files_table().orderBy("smallest_key").select(F.col("smallest_key").alias("key")).limit(1).collect()][0] == min(keys)


def test_compaction_works_in_bounded_steps(spark, tmp_path):
    rng, model, seq = random.Random(3), {}, 0
    store = Store.open(spark, str(tmp_path / "db"), "key long, value string", create_if_missing=True, limits=TINY)
    pinned, seen = None, None
    for step in range(6):
        rows = []
        for _ in range(150):
            seq += 1
            k = rng.randrange(400)
            gone = rng.random() < 0.25
            rows.append((k, seq, 0 if gone else 1, None if gone else f"{seq:040d}"))
            model.pop(k, None) if gone else model.__setitem__(k, f"{seq:040d}")
        store.write_log(changes(spark, rows), sealed=seq)
        if step == 2:
            pinned, seen = store.snapshot(), dict(model)
        steps = 0
        while store.compact() and steps < 40:
            steps += 1
        assert steps < 40 and live(store) == model
        deep = store.files_table().filter("level > 0")
        assert not [r for r in _overlaps(deep)]
    assert live(store, pinned) == seen
    assert max(f["level"] for f in store.files()) >= 2 and store._state["pointers"]
    work = {(r["kind"], r.level): r for r in store.statistics().collect()}
    assert work["write", 0].n == 6 and any(k == "merge" for k, _ in work)
    gone = store.collect_garbage()
    assert gone and live(store) == model and store.collect_garbage() == []


def test_small_files_are_compacted_in_few_merges(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), "key long, value double", create_if_missing=True, limits=TINY)
    rows = lambda n: spark.range(12_000).select((F.col("id") * 7919 % 12_007).alias("key"), (F.col("id") + 1 + 12_000 * n).alias("seq"), F.when(F.col("id") % 5 == n, 0).otherwise(1).cast("tinyint").alias("kind"), F.rand(n).alias("value"))
    merges = 0
    for n in range(3):
        store.write_log(rows(n), sealed=12_000 * (n + 1))
        while store.compact() and merges < 12:
            merges += 1
    assert merges < 12 and store.pick_level() is None and not _overlaps(store.files_table().filter("level > 0"))
    assert len(store.files()) > 20 and max(f["file_size"] for f in store.files() if f["level"] > 0) < 3 * TINY.file_bytes  # no Bloom filter of a megabyte in each
    want = {r.key: r.value for r in log.resolve(rows(0).union(rows(1)).union(rows(2))).collect()}
    assert live(store) == want


def test_streams_compact_in_few_merges(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(16_000).select((F.col("id") * 7919 % 4_001).alias("key"), (F.col("id") + 1).alias("seq"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).cast("tinyint").alias("kind"), F.rand(1).alias("value"))
    rows.repartition(2, F.xxhash64("seq")).write.parquet(source)
    store = Store.open(spark, str(tmp_path / "db"), "key long, value double", create_if_missing=True, limits=TINY)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = apply_log_stream(stream, store, str(tmp_path / "state"))
    assert query.awaitTermination(120) or query.stop()
    assert store.version <= 12 and store.pick_level() is None  # edits: the first, a write a micro-batch, and what was compacted
    assert live(store) == {r.key: r.value for r in log.resolve(spark.read.parquet(source)).collect()}


def _overlaps(files):
    from sediment.plans import manifest

    return manifest.check(files, 1 << 40).collect()


def test_late_changes_find_what_must_hide_them(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), "key long, value string", create_if_missing=True, limits=TINY)
    store.write_log(changes(spark, [(1, 9, 0, None), (2, 8, 1, "new")]))
    store.compact_range()
    store.write_log(changes(spark, [(1, 3, 1, "old"), (2, 2, 1, "old"), (3, 4, 1, "three")]))
    store.compact_range()
    assert live(store) == {2: "new", 3: "three"}
    store.write_log(changes(spark, []), "s", 0, sealed=9)  # now nothing at or below 9 comes any more
    store.compact_range()
    assert live(store) == {2: "new", 3: "three"}


def test_repeated_batches_are_written_once(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), "key long, value string", create_if_missing=True)
    rows = changes(spark, [(1, 1, 1, "a")])
    store.write_log(rows, "stream", 0)
    store.write_log(rows, "stream", 0)
    other = Store.open(spark, str(tmp_path / "db"))
    assert other.applied("stream", 0) and not other.applied("stream", 1) and not other.applied("else", 0)
    other.write_log(rows, "stream", 0)
    assert len(other.files()) == 1 and live(other) == {1: "a"}


def test_manifest_survives_crashes_and_rolls_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "ROLL", 3)
    store = Store.open(spark, str(tmp_path / "db"), "key long, value string", create_if_missing=True)
    for k in range(7):
        store.put(k, str(k))
    names = {p.name for p in (tmp_path / "db" / "manifest").iterdir()}
    assert "0000000006.roll.json" in names and "0000000008.json" in names
    (tmp_path / "db" / "manifest" / ".edit-0000000009.json-x").write_text('{"edit_id": 9, "add')  # a writer died before it published
    assert live(Store.open(spark, str(tmp_path / "db"))) == {k: str(k) for k in range(7)}
    assert live(Store.open(spark, str(tmp_path / "db"), version=4)) == {k: str(k) for k in range(3)}
    for n in (1, 2, 3):
        (tmp_path / "db" / "manifest" / f"000000000{n}.json").unlink()  # folded: no longer needed
    assert live(Store.open(spark, str(tmp_path / "db"))) == {k: str(k) for k in range(7)}
    late = Store.open(spark, str(tmp_path / "db"))
    store.put(1, "x")
    with pytest.raises(ConflictError):
        late.put(1, "y")
    with pytest.raises(StoreError) as e:
        Store._put(spark, "/proc/nowhere/0000000001.json", "x")
    assert not isinstance(e.value, ConflictError)


def test_settled_store_is_summed_in_place(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), create_if_missing=True, limits=Limits(file_bytes=20_000))
    rows = spark.range(5000).select(F.encode(F.format_string("%06d", "id"), "UTF-8").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("tinyint").alias("kind"), F.encode(F.repeat(F.md5(F.col("id").cast("string").cast("binary")), (F.col("id") % 4).cast("int")), "UTF-8").alias("value"))
    store.write_log(rows, sealed=1 << 30)
    store.compact_range()
    assert len(store.files()) > 3 and not store._settled(store.files())[1]
    data = b"".join(bytes(r.key) + bytes(r.value) for r in rows.orderBy("key").collect())
    want = (5000, codec.crc32c(data))
    assert tuple(store.checksum().first()) == tuple(ordered_checksum(store.scan()).first()) == want
    assert "Exchange" not in store.scan()._jdf.queryExecution().executedPlan().toString()
    store.delete(b"000007")
    assert store.scan().count() == 4999 and store.checksum().first().n_rows == 4999


def test_range_delete_and_throttle(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), "key long, value string", create_if_missing=True, limits=Limits(halt_l0=3))
    for n in range(6):
        store.put(n, "first")
        store.put(n, "second")
    assert len({f["dir"] for f in store.files() if f["level"] == 0}) <= 3
    store.compact_range(2, 4, F.col("key").between(2, 4))
    assert live(store) == {0: "second", 1: "second", 5: "second"}


def test_planner_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(0, 100 + k, rng.randrange(1, 99), *sorted(rng.choices(range(200), k=2))) for k in range(9)]
    for level in (1, 2, 3):
        ends = sorted(rng.sample(range(200), 24))
        rows += [(level, 1000 * level + k, rng.randrange(1, 99), ends[2 * k], ends[2 * k + 1]) for k in range(12)]
    files = spark.createDataFrame(rows, "level int, file_number long, file_size long, smallest_key long, largest_key long")
    got = {r.key: (r.n_files, r.charged_file) for r in planner.covering(files, spark.range(-2, 203).select(F.col("id").alias("key"))).collect()}
    for k in range(-2, 203):
        hits = sorted((r[0], -r[1]) for r in rows if r[3] <= k <= r[4])
        assert got.get(k) == ((len(hits), -hits[0][1] if len(hits) > 1 else None) if hits else None)
    moves = {r.file_number: r.grandparent_bytes for r in planner.trivial_moves(files, 1, Limits(grandparent_bytes=120)).collect()}
    meets = lambda a, b: a[3] <= b[4] and b[3] <= a[4]
    want = {}
    for f in (r for r in rows if r[0] == 1):
        grand = sum(r[2] for r in rows if r[0] == 3 and meets(f, r))
        if not any(r[0] == 2 and meets(f, r) for r in rows) and grand <= 120:
            want[f[1]] = grand
    assert moves == want
    keys = sorted(rng.sample(range(200), 60))
    cuts = {r.key: r.output for r in planner.output_cuts(spark.createDataFrame([(k,) for k in keys], "key long"), files, 1, 100).collect()}
    over, output, index, started = 0, 0, 0, False
    grand = sorted((r for r in rows if r[0] == 3), key=lambda r: r[4])
    for k in keys:  # one key after the other
        while index < len(grand) and grand[index][4] < k:
            over += grand[index][2] if started else 0
            index += 1
        started = True
        if over > 100:
            output, over = output + 1, 0
        assert cuts[k] == output


def test_foreign_database(spark, tmp_path):
    rows = [(b"%04d" % (k % 300), k + 1, int(k % 7 != 0), None if k % 7 == 0 else b"v%d" % k * 9) for k in range(2000)]
    folder = str(tmp_path / "db")
    all_ = changes(spark, rows, "binary", "binary")
    formats.write_database(all_.filter("seq <= 1500"), all_.filter("seq > 1500"), folder)
    want = {bytes(r.key): (r.seq, bytes(r.value)) for r in log.resolve(all_).collect()}
    read = lambda **o: {bytes(r.key): (r.seq, bytes(r.value)) for r in log.resolve(formats.read_database(spark, folder, **o)).collect()}
    assert read() == want == read(verify="false")
    logs = sorted(p for p in (tmp_path / "db").iterdir() if p.suffix == ".log")
    (tmp_path / "db" / "000001.log").write_bytes(b"old and not to be read")
    assert read() == want
    whole = logs[-1].read_bytes()
    logs[-1].write_bytes(whole[:-3])  # a crash cut the last record
    cut = read()
    assert cut != want and cut
    with pytest.raises(Exception, match="truncated"):
        read(tail="FAILFAST")
    hurt = bytearray(whole)
    hurt[30] ^= 1
    logs[-1].write_bytes(bytes(hurt))
    with pytest.raises(Exception, match="checksum"):
        read()
    logs[-1].write_bytes(whole)
    with pytest.raises(codec.Corrupt, match="comparator"):
        formats.read_database(spark, folder, comparator="other")
    next(p for p in (tmp_path / "db").iterdir() if p.suffix == ".ldb").unlink()
    with pytest.raises(codec.Corrupt, match="missing"):
        read()
    (tmp_path / "db" / ".CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "db" / "CURRENT").write_text("nothing")
    with pytest.raises(codec.Corrupt, match="CURRENT"):
        read()


def test_table_cursor_and_internal_keys():
    rng = random.Random(1)
    keys = sorted({b"%05d" % rng.randrange(99999) for _ in range(700)})
    entries = [(k, 9 - n, 1, b"v" * 20) for k in keys for n in range(2)]
    table = codec.Table(codec.table_write(entries, block_size=300))
    assert list(table.before()) == entries[::-1]
    for probe in (b"", b"00000", b"5", keys[3], keys[-1], b"99999x"):
        assert table.seek(probe) == next((e for e in entries if e[0] >= probe), None)
        assert table.seek_before(probe) == next((e for e in reversed(entries) if e[0] < probe), None)
    assert codec.separator(b"a\x01zz", b"a\x02b") == b"a\x02" and codec.separator(b"a\x01\xff\x05q", b"a\x02") == b"a\x01\xff\x06" and codec.separator(b"a\x01", b"a\x02") == b"a\x01"
    low, high = codec.internal_key(b"abcd", 5, 1), codec.internal_key(b"ax", 7, 1)
    assert codec.internal_separator(low, high) == codec.internal_key(b"ac", codec.MAX_SEQ + 1, 1) and codec.internal_successor(low) == codec.internal_key(b"b", codec.MAX_SEQ + 1, 1)
    assert codec.internal_separator(low, codec.internal_key(b"abcd", 2, 1)) == low
    assert codec.bloom_build([b"k"] * 3, 100)[-1] == 30 and len(codec.bloom_build([b"k"] * 3, 100)) == 43 * 3 // 8 + 2


def test_checksums_of_every_size():
    rng = random.Random(2)
    for n in (0, 1, 8191, 8192, 8193, 100_001, 1 << 20):
        data = rng.randbytes(n)
        want = codec._plain_crc(data, 0xFFFFFFFF) ^ 0xFFFFFFFF
        assert codec.crc32c(data) == want
        assert codec.crc32c(data[n // 3 :], codec.crc32c(data[: n // 3])) == want
