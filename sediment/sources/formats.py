"""Python Data Sources for foreign database files: `sst` tables, `wal` logs and `manifest` edit logs.

    spark.dataSource.register(SstSource)
    spark.read.format("sst").load("/path/to/tables")

Options: path (a file, or a folder whose files of the right kind are read; any URI that pyarrow
knows, see `located` for paths without a scheme), files (numbers, comma-separated: only these of a
folder), mode (PERMISSIVE: rows of problems are kept with `problem` set; DROPMALFORMED: left out;
FAILFAST: raise; TOLERATE_TAIL: a log that ends inside its last record is fine, anything else raises; default
PERMISSIVE), codecs (google or mojang, or id=name pairs) and verify (false: block checksums are not checked) for tables. Each file is one
partition. Predicates on `key` reach the table reader if
spark.sql.python.filterPushdown.enabled is on, and prune blocks.

`read_database` opens a whole database folder as one change log, `write_database` makes one.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from sediment.functions import codec


PART_BYTES = 8 << 20  # of a long manifest log, read by one task; whole blocks


class FilePart(InputPartition):
    def __init__(self, path: str, start: int = 0, stop: int | None = None, number: int = 0):
        self.path, self.start, self.stop, self.number = path, start, stop, number


def _log_part(path: str, start: int, stop: int):
    """Records and problems of the part [start, stop) of a log file."""
    system, root = _open(path)
    with system.open_input_file(root) as f:
        yield from codec.log_part(lambda at, end: f.read_at(end - at, at), f.size(), start, stop)


def manifest_parts(spark, path: str, part_bytes: int | None = None) -> list[tuple[str, int, int, int]]:
    """(path, start, stop, number of its first record) of parts of the manifest logs at `path`. Tasks count the records, as only a log's beginning says which number one has; a row a part comes back."""
    import pyarrow as pa

    step, parts = part_bytes or PART_BYTES, []
    for p in list_files(path, "MANIFEST"):
        system, root = _open(p)
        size = system.get_file_info(root).size
        parts += [(p, at, min(at + step, size)) for at in range(0, size, step)] or [(p, 0, 0)]
    counts = {}
    if len({p for p, _, _ in parts}) < len(parts):

        def run(batches):
            for batch in batches:
                for p, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (p, start, sum(1 for _ in _log_part(p, start, stop)))], ["path", "start", "n"])

        table = spark.createDataFrame(parts, "path string, start long, stop long").repartition(len(parts))
        counts = {(r.path, r.start): r.n for r in table.mapInArrow(run, "path string, start long, n long").collect()}
    out, number = [], 0
    for p, start, stop in parts:
        number = 0 if start == 0 else number
        out.append((p, start, stop, number))
        number += counts.get((p, start), 0)
    return out


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def located(spark, path: str) -> str:
    """`path` with its scheme: one without belongs to the session's default file system, as for Spark's own readers."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def list_files(path: str, kind: str) -> list[str]:
    """Database files of a kind at `path`, by number."""
    from pyarrow import fs

    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [path]
    found = []
    for f in system.get_file_info(fs.FileSelector(root)):
        parsed = codec.parse_name(f.base_name)
        if f.type == fs.FileType.File and parsed and parsed[0] == kind:
            found.append((parsed[1], f"{path.rstrip('/')}/{f.base_name}"))
    return [p for _, p in sorted(found)]


class _Reader(DataSourceReader):
    kind = ""

    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        named = options.get("codecs", "google")
        sets = {"google": codec.GOOGLE_CODECS, "mojang": codec.MOJANG_CODECS}
        self.codecs = sets[named] if named in sets else {0: "none"} | {int(k): v for k, v in (x.split("=") for x in named.split(","))}
        self.verify = options.get("verify", "true").lower() != "false"
        self.numbers = None if options.get("files") is None else {int(n) for n in options["files"].split(",") if n}

    def partitions(self):
        return [FilePart(p) for p in list_files(self.path, self.kind) if self.numbers is None or codec.parse_name(p.rpartition("/")[2])[1] in self.numbers]

    def data(self, part: FilePart) -> bytes:
        system, root = _open(part.path)
        with system.open_input_file(root) as f:
            return f.read()

    def trouble(self, row: tuple):
        """What a problem becomes; its text ends a row. A cut record can only be the last of a log."""
        if self.mode == "FAILFAST" or self.mode == "TOLERATE_TAIL" and not str(row[-1]).startswith("truncated"):
            raise codec.Corrupt(f"{row[0]}: {row[-1]}")
        return [row] if self.mode == "PERMISSIVE" else []


class SstReader(_Reader):
    kind = "table"
    low = high = None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                value = bytes(f.value)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low or b"", value)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.high = min(x for x in (self.high, value + b"\0") if x is not None)
                if isinstance(f, LessThan):
                    self.high = min(x for x in (self.high, value) if x is not None)
            yield f  # blocks are pruned; Spark still checks every row

    def read(self, part):
        name = part.path.rpartition("/")[2]
        try:
            for key, seq, kind, value in codec.Table(self.data(part), self.codecs, self.verify).entries(self.low, self.high):
                yield name, key, seq, kind, value, None
        except codec.Corrupt as e:
            yield from self.trouble((name, None, None, None, None, str(e)))


class WalReader(_Reader):
    kind = "log"

    def read(self, part):
        name = part.path.rpartition("/")[2]
        for at, record, problem in codec.log_read(self.data(part)):
            try:
                if problem:
                    raise codec.Corrupt(problem, at)
                for key, seq, kind, value in codec.batch_decode(record):
                    yield name, at, key, seq, kind, value, None
            except codec.Corrupt as e:
                yield from self.trouble((name, at, None, None, None, None, str(e)))


class ManifestReader(_Reader):
    kind = "MANIFEST"

    def __init__(self, options):
        super().__init__(options)
        self.parts = json.loads(options.get("parts", "null"))  # as manifest_parts gives them; without, a file is one

    def partitions(self):
        return super().partitions() if self.parts is None else [FilePart(*p) for p in self.parts]

    def read(self, part):
        name = part.path.rpartition("/")[2]
        records = codec.log_read(self.data(part)) if part.stop is None else _log_part(part.path, part.start, part.stop)
        for n, (at, record, problem) in enumerate(records, part.number):
            try:
                if problem:
                    raise codec.Corrupt(problem, at)
                e = codec.edit_decode(record)
                pointers = [{"level": level, "key": key} for level, key in e["compaction_pointers"]]
                deleted = [{"level": level, "file_number": number} for level, number in e["deleted"]]
                added = [dict(zip(("level", "file_number", "file_size", "smallest_key", "largest_key"), x)) for x in e["added"]]
                plain = [e.get(k) for k in ("log_number", "prev_log_number", "next_file_number", "last_sequence")]
                yield (name, n, (e.get("comparator") or b"").decode("utf-8", "replace") or None, *plain, pointers, deleted, added, None)
            except codec.Corrupt as e:
                yield from self.trouble((name, n, *[None] * 5, [], [], [], str(e)))


class SstSource(DataSource):
    @classmethod
    def name(cls):
        return "sst"

    def schema(self):
        return "file string, key binary, seq long, kind int, value binary, problem string"

    def reader(self, schema):
        return SstReader(self.options)


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "wal"

    def schema(self):
        return "file string, offset long, key binary, seq long, kind int, value binary, problem string"

    def reader(self, schema):
        return WalReader(self.options)


class ManifestSource(DataSource):
    @classmethod
    def name(cls):
        return "manifest"

    def schema(self):
        return (
            "file string, edit_id long, comparator string, log_number long, prev_log_number long, next_file_number long, last_sequence long, "
            "compaction_pointers array<struct<level:int,key:binary>>, deleted array<struct<level:int,file_number:long>>, "
            "added array<struct<level:int,file_number:long,file_size:long,smallest_key:binary,largest_key:binary>>, problem string"
        )

    def reader(self, schema):
        return ManifestReader(self.options)


def register(spark) -> None:
    """Register the sources; key predicates of tables need the setting below."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SstSource, WalSource, ManifestSource):
        spark.dataSource.register(source)


def load(spark, kind: str, path: str, **options):
    """The rows of a source, with `path` resolved like those of Spark's own readers; long manifests are read in parts."""
    register(spark)
    path = located(spark, path)
    if kind == "manifest":
        options = {"parts": json.dumps(manifest_parts(spark, path)), **options}
    return spark.read.format(kind).options(**options).load(path)


TABLE_BYTES = 32 << 20  # entries of one written table, about


def write_sst(log, folder: str, codec_name: str = "snappy", start: int = 1, table_bytes: int = TABLE_BYTES, codecs: dict[int, str] = codec.GOOGLE_CODECS):
    """Write a change log (binary key and value) as table files of disjoint key ranges; returns their rows (file_number, file_size, n_entries, smallest_key, largest_key), keys with tags.

    A task cuts its range into tables of about `table_bytes`, never inside a user key, and writes them aside under names of
    its own; the driver then numbers the tables that successful tasks report, in key order. A retried task leaves
    files that nobody reports, and they are deleted.
    """
    import uuid

    import pyarrow as pa
    from pyspark.sql import functions as F

    spark = log.sparkSession
    folder = located(spark, folder)
    aside = f"{folder}/aside-{uuid.uuid4().hex}"
    names = ["name", "file_size", "n_entries", "smallest_key", "largest_key"]

    def run(batches):
        system, root = _open(aside)
        system.create_dir(root, recursive=True)
        held, size = [], 0

        def close():
            name = uuid.uuid4().hex
            data = codec.table_write(held, codec=codec_name, codecs=codecs)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            ends = [codec.internal_key(*held[k][:3]) for k in (0, -1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ([name], [len(data)], [len(held)], ends[:1], ends[1:])], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= table_bytes and row[0] != held[-1][0]:
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += len(row[0]) + len(row[3] or b"") + 8
        if held:
            yield close()

    dealt = log.select("key", "seq", F.col("kind").cast("int").alias("kind"), "value").repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"), F.desc("kind"))
    found = dealt.mapInArrow(run, "name string, file_size long, n_entries long, smallest_key binary, largest_key binary").collect()  # one row a table
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for k, r in enumerate(sorted(found, key=lambda r: bytes(r.smallest_key[:-8]))):
        fs.rename(path(f"{aside}/{r.name}"), path(f"{folder}/{codec.format_name('table', start + k)}"))
        rows.append((start + k, r.file_size, r.n_entries, r.smallest_key, r.largest_key))
    fs.delete(path(aside), True)
    return spark.createDataFrame(rows, "file_number long, file_size long, n_entries long, smallest_key binary, largest_key binary")


def put_file(spark, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def read_bytes(spark, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


COMPARATOR = "leveldb.BytewiseComparator"


def write_wal(log, folder: str, start: int = 1, records: int = 1000):
    """Write changes with consecutive sequence numbers as log files, one a range of numbers, batches of up to `records` changes; returns (file_number, n_changes)."""
    import uuid

    import pyarrow as pa
    from pyspark.sql import functions as F

    spark = log.sparkSession
    folder = located(spark, folder)
    aside = f"{folder}/aside-{uuid.uuid4().hex}"

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))  # a range of one log file
        if not rows:
            return
        system, root = _open(aside)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        cuts, out = [0], []
        for k in range(1, len(rows) + 1):
            if k == len(rows) or k - cuts[-1] == records or rows[k][1] != rows[k - 1][1] + 1:
                out.append(codec.batch_encode(rows[cuts[-1]][1], [(kind, key, value) for key, _, kind, value in rows[cuts[-1] : k]]))
                cuts.append(k)
        with system.open_output_stream(f"{root}/{name}") as f:
            f.write(codec.log_write(out))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows[0][1]]), pa.array([len(rows)])], ["name", "first", "n_changes"])

    dealt = log.select("key", "seq", F.col("kind").cast("int").alias("kind"), "value").repartitionByRange("seq").sortWithinPartitions("seq")
    found = sorted(dealt.mapInArrow(run, "name string, first long, n_changes long").collect(), key=lambda r: r.first)  # one row a file
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, r in enumerate(found):
        fs.rename(path(f"{aside}/{r.name}"), path(f"{folder}/{codec.format_name('log', start + k)}"))
    fs.delete(path(aside), True)
    return spark.createDataFrame([(start + k, r.n_changes) for k, r in enumerate(found)], "file_number long, n_changes long")


def write_manifest(edits, folder: str, number: int = 2) -> None:
    """Write edits (the columns of the manifest source, some may be absent) as one manifest log, in order of edit_id.

    Tasks write ranges of edits aside, filled up with zeros to whole blocks, which readers pass over; then one task appends the parts to
    each other, as one file has one writer. The driver sees a row a part.
    """
    import uuid

    import pyarrow as pa

    spark = edits.sparkSession
    folder = located(spark, folder)
    aside = f"{folder}/aside-{uuid.uuid4().hex}"
    target = f"{folder}/{codec.format_name('MANIFEST', number)}"
    names = [c for c in edits.columns if c not in ("file", "problem")]

    def run(batches):
        out, first = [], None
        for batch in batches:
            for row in batch.to_pylist():
                edit = dict(row)
                if edit.get("comparator") is not None:
                    edit["comparator"] = edit["comparator"].encode()
                for name, fields in (("compaction_pointers", ("level", "key")), ("deleted", ("level", "file_number")), ("added", ("level", "file_number", "file_size", "smallest_key", "largest_key"))):
                    edit[name] = [tuple(x[f] for f in fields) for x in edit.get(name) or []]
                first = row["edit_id"] if first is None else first
                out.append(codec.edit_encode(edit))
        if not out:
            return
        system, root = _open(aside)
        system.create_dir(root, recursive=True)
        name, data = uuid.uuid4().hex, codec.log_write(out)
        with system.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([len(data)])], ["name", "first", "size"])

    dealt = edits.select(*names).repartitionByRange("edit_id").sortWithinPartitions("edit_id")
    parts = sorted(dealt.mapInArrow(run, "name string, first long, size long").collect(), key=lambda r: r.first)  # one row a part
    listed = [(r.name, r.size) for r in parts]

    def append(batches):
        for _ in batches:
            system, root = _open(aside)
            whole = f"{root}/{uuid.uuid4().hex}"
            with system.open_output_stream(whole) as out:
                for k, (name, size) in enumerate(listed):
                    with system.open_input_stream(f"{root}/{name}") as part:
                        while data := part.read(1 << 22):
                            out.write(data)
                    if k + 1 < len(listed):
                        out.write(bytes(-size % codec.LOG_BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([whole.rpartition("/")[2]])], ["name"])

    if not listed:
        put_file(spark, target, b"")
        return
    whole = spark.range(0, 1, 1, 1).mapInArrow(append, "name string").first().name
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(target), False)
    fs.rename(path(f"{aside}/{whole}"), path(target))
    fs.delete(path(aside), True)


def write_database(flushed, recent, folder: str, level: int = 1, codec_name: str = "snappy", comparator: str = COMPARATOR) -> None:
    """Make a database folder: `flushed` changes as tables of a level, `recent` ones as logs, a manifest and CURRENT."""
    spark = flushed.sparkSession
    tables = write_sst(flushed, folder, codec_name, start=4)
    listed = tables.collect()  # one row a table, as in the manifest
    logs = write_wal(recent, folder, start=4 + len(listed))
    n_logs = logs.count()
    last = max(flushed.agg({"seq": "max"}).first()[0] or 0, 0)
    first = {"comparator": comparator.encode(), "log_number": 0, "next_file_number": 3, "last_sequence": 0}
    rest = {"log_number": 4 + len(listed), "next_file_number": 4 + len(listed) + n_logs, "last_sequence": last, "added": [(level, r.file_number, r.file_size, bytes(r.smallest_key), bytes(r.largest_key)) for r in listed]}
    put_file(spark, f"{folder}/{codec.format_name('MANIFEST', 2)}", codec.log_write([codec.edit_encode(first), codec.edit_encode(rest)]))
    put_file(spark, f"{folder}/CURRENT", b"MANIFEST-000002\n")


def read_database(spark, folder: str, comparator: str = COMPARATOR, tail: str = "TOLERATE_TAIL", **options):
    """All changes (key, seq, kind, value) of a database folder: CURRENT names the manifest, its edits fold to the live tables and the logs to replay.

    Logs count if their number is at least the manifest's log number, or is its previous log number. A missing counter,
    another comparator and a missing table are errors; `tail` is the mode for logs, whose last record may have been cut by a crash.
    """
    from pyspark.sql import functions as F

    from sediment.plans import manifest

    register(spark)
    folder = located(spark, folder)
    name = read_bytes(spark, f"{folder}/CURRENT").decode("ascii", "replace")
    if not name.endswith("\n") or (codec.parse_name(name[:-1]) or ("",))[0] != "MANIFEST":
        raise codec.Corrupt("CURRENT names no manifest")
    edits = load(spark, "manifest", f"{folder}/{name[:-1]}", mode="FAILFAST")
    counters = manifest.fold_counters(edits).first()
    lacking = [c for c in ("log_number", "next_file_number", "last_sequence") if counters[c] is None]
    if lacking:
        raise codec.Corrupt(f"the manifest lacks {', '.join(lacking)}")
    if counters.comparator != comparator:
        raise codec.Corrupt(f"the database's comparator is {counters.comparator}")
    live = {r.file_number for r in manifest.live_files(edits).select("file_number").collect()}  # one row a file
    there = {codec.parse_name(p.rpartition("/")[2])[1] for p in list_files(folder, "table")}
    if live - there:
        raise codec.Corrupt(f"missing tables {sorted(live - there)}")
    logs = [n for p in list_files(folder, "log") if (n := codec.parse_name(p.rpartition("/")[2])[1]) >= counters.log_number or n == (counters.prev_log_number or -1)]
    columns = ["key", "seq", F.col("kind").cast("tinyint").alias("kind"), "value"]
    out = spark.read.format("sst").options(**{"mode": "FAILFAST", **options}, files=",".join(map(str, sorted(live)))).load(folder).select(*columns)
    if logs:
        out = out.unionByName(spark.read.format("wal").options(mode=tail, files=",".join(map(str, logs))).load(folder).select(*columns))
    return out
