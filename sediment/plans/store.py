"""A store: a folder of key-sorted Parquet runs and a manifest log, read and written as DataFrames.

Folder layout: data/NNNNNN-xxxxxxxx/ (the files of one run), manifest/NNNNNNNNNN.json (one edit each) and
.../NNNNNNNNNN.roll.json (the folded state after that edit, every ROLL edits). The manifest has an entry a Parquet file with its
key range, so reads, merges and size estimates touch only the files that can matter.

An edit is written aside and published by a rename that fails if its number is taken, so a reader never sees half an edit and a
writer that loses the race gets ConflictError and can retry; other trouble of the file system is StoreError. (On object stores without
rename the connector must offer a conditional put.) Readers fix a version when they open it.

Key ends are kept as text that gives the value back exactly (bytes in hex, decimals, dates and timestamps in their plain forms) and are compared as values.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sediment.operators.batch import WriteBatch, assign_sequences
from sediment.operators.cursor import Cursor
from sediment.operators.checksum import ordered_checksum, stored_checksum
from sediment.operators.log import DELETE, get, multi_get, resolve
from sediment.plans import planner
from sediment.plans.compact import compact
from sediment.plans.planner import Limits

BLOOM_KEYS = 1_000_000  # distinct keys that a file's Parquet Bloom filter is sized for at most
ROLL = 32  # edits from one folded manifest to the next
_RUN = re.compile(r"\d{6,}-[0-9a-f]{8}")
_EDIT = re.compile(r"(\d{10})(\.roll)?\.json")
_PIN = re.compile(r"(\d{18})-\d{10}")


class StoreError(Exception):
    pass


class ConflictError(StoreError):
    """Another writer committed this edit number first."""


def _shown(key):
    if isinstance(key, bytes | bytearray):
        return bytes(key).hex()
    return key if key is None or isinstance(key, bool | int | float | str) else str(key)


def _parsed(kind: str, shown):
    """The value that _shown stands for, of a Spark type's simple name."""
    if kind == "binary":
        return bytes.fromhex(shown)
    if kind.startswith("decimal"):
        return decimal.Decimal(shown)
    if kind == "date":
        return datetime.date.fromisoformat(shown)
    if kind.startswith("timestamp"):
        return datetime.datetime.fromisoformat(shown)
    return shown


class Store:
    def __init__(self, spark: SparkSession, path: str, state: dict, limits: Limits = Limits()):
        self.spark, self.path, self._state, self._closed, self.limits, self._kind = spark, path.rstrip("/"), state, False, limits, None

    # opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str | None = None, comparator: str = "bytewise", create_if_missing: bool = False, error_if_exists: bool = False, codec: str = "zstd", limits: Limits = Limits(), version: int | None = None) -> Store:
        """Open or create, at the last or an earlier version. `schema` gives the types of key and value on creation ("key binary, value binary" if absent)."""
        path = path.rstrip("/")
        exists = bool(cls._names(spark, f"{path}/manifest"))
        if exists and error_if_exists:
            raise StoreError("the store exists")
        if not exists:
            if not create_if_missing:
                raise StoreError("the store does not exist")
            types = StructType.fromDDL(schema or "key binary, value binary")
            cls._publish(spark, path, {"edit_id": 1, "comparator": comparator, "schema": types.jsonValue(), "codec": codec, "next_file_number": 1, "last_sequence": 0, "sealed": 0, "added": [], "deleted": []})
        store = cls(spark, path, cls._fold(spark, path, version), limits)
        if store._state["comparator"] != comparator:
            raise StoreError(f"the store's comparator is {store._state['comparator']}")
        return store

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._closed = True

    @property
    def closed(self) -> bool:
        return self._closed

    @classmethod
    def destroy(cls, spark: SparkSession, path: str) -> None:
        """Delete what a store writes and nothing else; a missing store is fine."""
        fs, root = cls._fs(spark, path)
        for part, ours in (("data", _RUN), ("manifest", _EDIT), ("snapshots", _PIN)):
            for name in cls._names(spark, f"{path}/{part}"):
                if ours.fullmatch(name) or name.startswith(".edit-"):
                    fs.delete(cls._hadoop(spark, f"{path}/{part}/{name}"), True)
            cls._drop_empty(spark, f"{path}/{part}")
        cls._drop_empty(spark, path)

    # files

    @staticmethod
    def _hadoop(spark, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    @classmethod
    def _fs(cls, spark, path: str):
        root = cls._hadoop(spark, path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), root

    @classmethod
    def _names(cls, spark, folder: str) -> list[str]:
        fs, root = cls._fs(spark, folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    @classmethod
    def _drop_empty(cls, spark, folder: str) -> None:
        fs, root = cls._fs(spark, folder)
        if fs.exists(root) and not fs.listStatus(root):
            fs.delete(root, False)

    @classmethod
    def _put(cls, spark, path: str, text: str) -> None:
        """Write a file aside, then give it its name if nobody has."""
        fs, at = cls._fs(spark, path)
        folder, _, name = path.rpartition("/")
        aside = cls._hadoop(spark, f"{folder}/.edit-{name}-{uuid.uuid4().hex}")
        jvm = spark._jvm.org.apache.hadoop.fs
        try:
            out = fs.create(aside, False)
            out.write(bytearray(text.encode()))
            out.close()
            plain = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
            plain[0] = getattr(jvm, "Options$Rename").NONE
            jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(at), plain)
        except Py4JJavaError as e:
            taken = e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException" or fs.exists(at)
            fs.delete(aside, False)
            raise (ConflictError(f"{path} exists") if taken else StoreError(f"{path}: {e.java_exception}")) from e

    @classmethod
    def _publish(cls, spark, path: str, edit: dict) -> None:
        cls._put(spark, f"{path}/manifest/{edit['edit_id']:010d}.json", json.dumps(edit))

    @classmethod
    def _json(cls, spark, path: str) -> dict:
        fs, at = cls._fs(spark, path)
        stream = fs.open(at)
        try:
            return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError as e:
            raise StoreError(f"{path} is damaged") from e
        finally:
            stream.close()

    @staticmethod
    def _apply(state: dict, edit: dict) -> dict:
        """The state after an edit; deletions come first."""
        files = dict(state.get("files", {}))
        for n in edit.get("deleted", []):
            files.pop(n, None)
        files |= {f["file_number"]: f for f in edit.get("added", [])}
        pointers = state.get("pointers", {}) | edit.get("pointers", {})
        applied = state.get("applied", {}) | edit.get("applied", {})
        rest = {k: v for k, v in edit.items() if k not in ("added", "deleted", "pointers", "applied", "work") and v is not None}
        return state | rest | {"files": files, "pointers": pointers, "applied": applied}

    @classmethod
    def _fold(cls, spark, path: str, version: int | None = None) -> dict:
        """The state at a version: the newest folded manifest at or before it and the edits that follow."""
        found = [(int(m[1]), bool(m[2])) for n in cls._names(spark, f"{path}/manifest") if (m := _EDIT.fullmatch(n))]
        edits = sorted(n for n, rolled in found if not rolled and (version is None or n <= version))
        base = max((n for n, rolled in found if rolled and (version is None or n <= version)), default=0)
        state: dict = {"files": {}, "edit_id": 0}
        if base:
            state = cls._json(spark, f"{path}/manifest/{base:010d}.roll.json")
            state["files"] = {f["file_number"]: f for f in state["files"]}
        later = [n for n in edits if n > base]
        if not base and not later or later != list(range(base + 1, base + 1 + len(later))):
            raise StoreError("the manifest has gaps")
        for n in later:
            state = cls._apply(state, cls._json(spark, f"{path}/manifest/{n:010d}.json"))
        missing = [k for k in ("comparator", "schema", "next_file_number", "last_sequence") if k not in state]
        if missing:
            raise StoreError(f"the manifest lacks {', '.join(missing)}")
        return state

    def _commit(self, **edit) -> None:
        if self._closed:
            raise StoreError("the store is closed")
        edit["edit_id"] = self._state["edit_id"] + 1
        self._publish(self.spark, self.path, edit)
        self._state = self._apply(self._state, edit)
        if edit["edit_id"] % ROLL == 0:
            try:
                self._put(self.spark, f"{self.path}/manifest/{edit['edit_id']:010d}.roll.json", json.dumps(self._state | {"files": list(self._state["files"].values())}))
            except ConflictError:
                pass

    @property
    def version(self) -> int:
        return self._state["edit_id"]

    @property
    def last_sequence(self) -> int:
        return self._state["last_sequence"]

    @property
    def schema(self) -> StructType:
        types = StructType.fromJson(self._state["schema"])
        return StructType([types["key"], *StructType.fromDDL("seq long, kind tinyint").fields, types["value"]])

    def files(self) -> list[dict]:
        return sorted(self._state["files"].values(), key=lambda f: (f["level"], f["file_number"]))

    def _ends(self, f: dict) -> tuple:
        if self._kind is None:  # the same for every version
            self._kind = self.schema["key"].dataType.simpleString()
        return _parsed(self._kind, f["smallest_key"]), _parsed(self._kind, f["largest_key"])

    def _hull(self, files: list[dict]) -> tuple:
        """The smallest and the largest key of files."""
        ends = [self._ends(f) for f in files]
        return min(a for a, _ in ends), max(b for _, b in ends)

    def _meeting(self, low=None, high=None, levels=None) -> list[dict]:
        """Files whose range meets [low, high]."""
        out = []
        for f in self.files():
            if levels is None or f["level"] in levels:
                a, b = self._ends(f)
                if (low is None or b >= low) and (high is None or a <= high):
                    out.append(f)
        return out

    def files_table(self, files: list[dict] | None = None) -> DataFrame:
        """The manifest's files, or some of them, as the table that the planner's functions take."""
        kind = self.schema["key"].dataType
        rows = [(f["level"], f["file_number"], f["file_size"], *self._ends(f)) for f in (self.files() if files is None else files)]
        types = StructType.fromDDL("level int, file_number long, file_size long").add("smallest_key", kind).add("largest_key", kind)
        return self.spark.createDataFrame(rows, types)

    def _runs(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f['dir']}/{f['file']}" for f in files])

    def _write_run(self, rows: DataFrame, level: int, n_files: int | None = None, cuts: DataFrame | None = None, most_rows: int | None = None) -> list[dict]:
        """A sorted run as files of disjoint key ranges, with min/max statistics and a Bloom filter on key: their manifest entries.

        Without n_files adaptive execution sizes them. cuts (key, output): no file holds keys of two outputs. most_rows, if known, bounds
        the Bloom filters.
        """
        name = f"{self._state['next_file_number']:06d}-{uuid.uuid4().hex[:8]}"  # two writers may take the same number; only one of them commits it
        target = f"{self.path}/data/{name}"
        rows = rows.select("key", "seq", "kind", "value")
        by = ["key"]
        if cuts is not None:
            rows, by = rows.join(cuts, "key"), ["output", "key"]
        dealt = rows.repartitionByRange(*([n_files] if n_files else []), *by).sortWithinPartitions(*by, F.desc("seq"), F.desc("kind"))
        keys = BLOOM_KEYS if most_rows is None else min(BLOOM_KEYS, 2 * math.ceil(most_rows / (n_files or 1)) + 64)
        bloom = {"enabled#key": "true", "adaptive.enabled": "true", "max.bytes": str(1 << min(20, (keys * 10 // 8).bit_length())), "candidates.number": "12"}  # the smallest that suits a file's keys
        out = dealt.write.option("maxRecordsPerFile", 0).option("compression", self._state["codec"]).options(**{f"parquet.bloom.filter.{k}": v for k, v in bloom.items()})
        (out if cuts is None else out.partitionBy("output")).parquet(target)
        entries = self._describe(name, level, self._state["next_file_number"])
        if not entries:
            fs, root = self._fs(self.spark, target)
            fs.delete(root, True)
        return entries

    def _describe(self, name: str, level: int, number: int) -> list[dict]:
        """Manifest entries of a run folder, from its own rows: numbered from `number` in key order, none for empty files."""
        target = f"{self.path}/data/{name}"
        stored = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(target)
        ends = stored.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == DELETE).alias("gone"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("top"))
        rows = ends.orderBy("low", "path").collect()  # one row a file, like the manifest
        inside = lambda path: path.rpartition(f"/{name}/")[2]
        return [{"level": level, "file_number": number + k, "dir": name, "file": inside(r.path), "n_entries": r.n, "n_deletes": r.gone, "file_size": r.bytes, "smallest_key": _shown(r.low), "largest_key": _shown(r.high), "largest_seq": r.top} for k, r in enumerate(rows)]

    # writing

    def write(self, ops: WriteBatch | DataFrame, source: str | None = None, batch_id: int | None = None) -> int:
        """Apply a batch, or a DataFrame of (batch, ordinal, kind, key, value), atomically as a new level-0 run; returns the last sequence number.

        With a source's name and batch id, a batch that the manifest already has is skipped.
        """
        if self.applied(source, batch_id):
            return self.last_sequence
        if isinstance(ops, WriteBatch):
            types = self.schema
            ops = ops.to_rows(self.spark, types["key"].dataType.simpleString(), types["value"].dataType.simpleString()).withColumn("batch", F.lit(0).cast("long"))
        return self._append(assign_sequences(ops, self.last_sequence), source, batch_id, None)

    def write_log(self, rows: DataFrame, source: str | None = None, batch_id: int | None = None, sealed: int | None = None) -> int:
        """Add changes (key, seq, kind, value) under their own sequence numbers; late ones resolve by number, not by arrival.

        `sealed` says that no change at or below it will come any more. Compaction forgets deletes and old
        versions only up to there, so that what comes late finds what must hide it.
        """
        if self.applied(source, batch_id):
            return self.last_sequence
        return self._append(rows, source, batch_id, self._state.get("sealed", 0) if sealed is None else sealed)

    def applied(self, source: str | None, batch_id: int | None) -> bool:
        return source is not None and batch_id is not None and batch_id <= self._state.get("applied", {}).get(source, -1)

    def _append(self, rows: DataFrame, source: str | None, batch_id: int | None, sealed: int | None) -> int:
        if self._closed:
            raise StoreError("the store is closed")
        while len({f["dir"] for f in self.files() if f["level"] == 0}) >= self.limits.halt_l0:  # writers wait for compaction, here by doing it
            if not self.compact(0):
                break
        added = self._write_run(rows, 0)
        mark = {} if source is None or batch_id is None else {source: batch_id}
        if added or mark:
            last = max([self.last_sequence, *(f["largest_seq"] for f in added)])
            work = {"kind": "write", "level": 0, "read": 0, "written": sum(f["file_size"] for f in added)}
            self._commit(added=added, deleted=[], next_file_number=self._state["next_file_number"] + len(added), last_sequence=last, sealed=last if sealed is None else sealed, applied=mark, work=work)
        return self.last_sequence

    def put(self, key, value) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key) -> int:
        return self.write(WriteBatch().delete(key))

    # reading

    def log(self, low=None, high=None) -> DataFrame:
        """All versions. Files whose range cannot meet [low, high] are left out before anything is opened."""
        return self._runs(self._meeting(low, high))

    def _settled(self, files: list[dict]) -> tuple[list[dict], list[dict]]:
        """Files whose rows are live as they are (one version a key, no delete, no other file over their range), in key order; and the rest."""
        ordered = sorted(((*self._ends(f), f) for f in files), key=lambda x: x[:2])
        settled, rest, upto = [], [], None
        for k, (low, high, f) in enumerate(ordered):
            alone = (upto is None or upto < low) and (k + 1 == len(ordered) or ordered[k + 1][0] > high)
            (settled if alone and f.get("single") and not f["n_deletes"] else rest).append(f)
            upto = high if upto is None else max(upto, high)
        return settled, rest

    def scan(self, as_of: int | None = None, low=None, high=None) -> DataFrame:
        """Live rows, of keys in [low, high] if given. Settled files are read as they are; only the rest is merged, which is what costs a shuffle."""
        settled, rest = self._settled(self._meeting(low, high))

        def seen(log: DataFrame) -> DataFrame:
            for bound, test in ((low, F.col("key") >= F.lit(low)), (high, F.col("key") <= F.lit(high))):
                log = log if bound is None else log.filter(test)
            return log

        plain = seen(self._runs(settled)).drop("kind")
        plain = plain if as_of is None else plain.filter(F.col("seq") <= F.lit(as_of))
        if not rest:
            return plain
        merged = resolve(seen(self._runs(rest)), as_of)
        return plain.unionByName(merged) if settled else merged

    def checksum(self) -> DataFrame:
        """One row: n_rows and the crc32c of all live keys and values (binary) in key order. A store of settled files is summed in place, without a shuffle."""
        settled, rest = self._settled(self.files())
        if rest or not settled:
            return ordered_checksum(self.scan())
        tail = lambda path: F.xxhash64(F.substring_index(path, "/", -3))
        rows = self._runs(settled).select("key", "value", tail(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.row_index").alias("row"))
        names = self.spark.createDataFrame([(f"{self.path}/data/{f['dir']}/{f['file']}", k) for k, f in enumerate(settled)], "name string, place long")
        return stored_checksum(rows, names.select(tail(F.col("name")).alias("path"), "place"))

    def get(self, key, as_of: int | None = None):
        row = get(self.log(key, key), key, as_of).first()
        return None if row is None else row.value

    def multi_get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        return multi_get(self.log(), keys, as_of)

    def cursor(self, as_of: int | None = None) -> Cursor:
        return Cursor(self.scan(as_of).select("key", "value"))

    # snapshots

    def snapshot(self) -> int:
        """Pin the current sequence number; versions it can see survive compaction until it is released."""
        try:
            self._put(self.spark, f"{self.path}/snapshots/{self.last_sequence:018d}-{self.version:010d}", "")
        except ConflictError:
            pass
        return self.last_sequence

    def _pins(self) -> list[tuple[int, str]]:
        return [(int(m[1]), n) for n in self._names(self.spark, f"{self.path}/snapshots") if (m := _PIN.fullmatch(n))]

    def release(self, seq: int) -> None:
        fs, _ = self._fs(self.spark, self.path)
        for pinned, name in self._pins():
            if pinned == seq:
                fs.delete(self._hadoop(self.spark, f"{self.path}/snapshots/{name}"), False)

    def oldest_snapshot(self) -> int:
        return min((seq for seq, _ in self._pins()), default=self.last_sequence)

    # compaction

    def pick_level(self) -> int | None:
        """The level most in need of compaction, by the planner's scores."""
        row = planner.choose_level(self.files_table(), self.limits).first()
        return None if row is None else row.level

    def compact(self, level: int | None = None) -> bool:
        """One merge of what a level holds beyond its limit; without `level`, of the most pressing one. Snapshots keep seeing what they saw.

        Level 0 gives the files that overlap its oldest one, directly or through others, then the next oldest, until few enough are left; a
        deeper level the files after its rotation pointer. Files that share a user key go together. However small the files are, a store
        is thus compacted in a few jobs a level, each as large as the excess and what it meets below.
        """
        level = self.pick_level() if level is None else level
        if level is None:
            return False
        here = {f["file_number"]: f for f in self.files() if f["level"] == level}
        base = (self._oldest_groups if level == 0 else self._after_pointer)(here, level) if here else []
        return self._merge(base, level) if base else False

    def _oldest_groups(self, here: dict[int, dict], level: int) -> list[dict]:
        groups: dict[int, list[int]] = {}
        for r in planner.overlap_groups(self.files_table(list(here.values())), level).select("overlap_group", "file_number").collect():  # one row a file
            groups.setdefault(r.overlap_group, []).append(r.file_number)
        out: list[dict] = []
        for numbers in sorted(groups.values(), key=min):
            if out and len(here) - len(out) < self.limits.l0_files:
                break
            out += [here[n] for n in numbers]
        return out

    def _after_pointer(self, here: dict[int, dict], level: int) -> list[dict]:
        """Neighbours from the rotation pointer on, until the level is below its limit or ends."""
        ordered = sorted(((*self._ends(f), f["file_number"]) for f in here.values()))
        pointer = self._state.get("pointers", {}).get(str(level))
        bound = None if pointer is None else _parsed(self._kind, pointer)
        start = next((k for k, (_, high, _) in enumerate(ordered) if bound is not None and high > bound), 0)
        shares = lambda k: 0 < k < len(ordered) and ordered[k - 1][1] == ordered[k][0]
        while shares(start):
            start -= 1
        stop, left = start, sum(f["file_size"] for f in here.values())
        while stop < len(ordered) and (stop == start or left >= self._full(level) or shares(stop)):
            left -= here[ordered[stop][2]]["file_size"]
            stop += 1
        return [here[n] for _, _, n in ordered[start:stop]]

    def _full(self, level: int) -> float:
        """Bytes at which a level from 1 on is due, as in planner.level_scores; the last one never is."""
        return self.limits.base_bytes * float(self.limits.ratio) ** (level - 1) if level < self.limits.levels - 1 else math.inf

    def compact_range(self, low=None, high=None, drop: Column | None = None) -> int:
        """Push what overlaps [low, high] down level by level, a merge each; returns how many ran.

        `drop` (a predicate on key and value) deletes the live rows that it names on the way, older versions
        included; with it every level that holds the range is rewritten.
        """
        merges = 0
        deepest = max((f["level"] for f in self._meeting(low, high)), default=0)
        for level in range(deepest + 1 if drop is not None else max(deepest, 1)):
            base = self._meeting(low, high, [level])
            if base:
                merges += self._merge(base, level, drop, manual=True)
        return merges

    def _merge(self, base: list[dict], level: int, drop: Column | None = None, manual: bool = False) -> bool:
        """Merge neighbours of a level into the next, or straight into the first deeper one that has room for them and for what they meet on the way."""
        to, low, high = level, *self._hull(base)
        parents: list[dict] = []
        while to < self.limits.levels - 1:
            to += 1
            met = self._meeting(low, high, [to])
            parents += met
            low, high = self._hull(base + parents)
            held = {f["file_number"] for f in met}
            size = sum(f["file_size"] for f in base + parents) + sum(f["file_size"] for f in self.files() if f["level"] == to and f["file_number"] not in held)
            if manual or size < self._full(to) or level and not parents:
                break
        size = sum(f["file_size"] for f in base + parents)
        if level > 0 and not manual and to == level + 1 and parents and size < self.limits.expand_bytes:  # base files may grow while no parent joins
            numbers = {r.file_number for r in planner.expand_inputs(self.files_table(), level, *self._hull(base), self.limits).filter(F.col("level") == level).collect()}
            base = [f for f in self.files() if f["level"] == level and f["file_number"] in numbers]
            size = sum(f["file_size"] for f in base + parents)
            low, high = self._hull(base + parents)
        pointer = {str(level): _shown(self._hull(base)[1])}
        gone = {f["file_number"] for f in base + parents}
        if not manual and level > 0 and not parents and to > level:
            movable = {r.file_number for r in planner.trivial_moves(self.files_table(), level, self.limits).select("file_number").collect()}  # at most one row a file
            if gone <= movable:
                self._commit(added=[f | {"level": to} for f in base], deleted=sorted(gone), pointers=pointer, work={"kind": "move", "level": to, "read": 0, "written": 0})
                return True
        others = [f for f in self._meeting(low, high) if f["file_number"] not in gone]  # any of them may hold what a delete still hides
        bound = min(self.oldest_snapshot(), self._state.get("sealed", self.last_sequence))
        kept = compact(self._runs(base + parents), bound, self.files_table(others) if others else None, drop)
        single = all(f["largest_seq"] <= bound for f in base + parents)  # then one version of each key is left
        grand = [f for f in others if f["level"] == to + 1]
        cuts = planner.output_cuts(kept.select("key"), self.files_table(grand), to - 1, self.limits.grandparent_bytes) if grand else None
        n_files = max(1, math.ceil(size / self.limits.file_bytes))
        added = [f | {"single": single} for f in self._write_run(kept, to, n_files, cuts, sum(f["n_entries"] for f in base + parents))]
        work = {"kind": "merge", "level": to, "read": size, "written": sum(f["file_size"] for f in added)}
        self._commit(added=added, deleted=sorted(gone), pointers=pointer, next_file_number=self._state["next_file_number"] + len(added), work=work)
        return True

    # copies and repair

    def checkpoint(self, target: str) -> Store:
        """A new store at `target` with the files of the current version."""
        fs, _ = self._fs(self.spark, self.path)
        out, root = self._fs(self.spark, target)
        if out.exists(root):
            raise StoreError("the target exists")
        copy = self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy
        for f in self.files():
            to = self._hadoop(self.spark, f"{target}/data/{f['dir']}/{f['file']}")
            out.mkdirs(to.getParent())
            copy(fs, self._hadoop(self.spark, f"{self.path}/data/{f['dir']}/{f['file']}"), out, to, False, self.spark._jsc.hadoopConfiguration())
        keep = {k: v for k, v in self._state.items() if k not in ("files", "edit_id")}
        self._publish(self.spark, target, {"edit_id": 1, **keep, "added": self.files(), "deleted": []})
        return Store.open(self.spark, target, comparator=keep["comparator"])

    @classmethod
    def repair(cls, spark: SparkSession, path: str, schema: str, comparator: str = "bytewise", codec: str = "zstd") -> Store:
        """Rebuild the manifest from whatever runs can be read, all in level 0; the old manifest is kept aside. Versions resolve by sequence number, so no live row changes."""
        path = path.rstrip("/")
        fs, _ = cls._fs(spark, path)
        old = cls._hadoop(spark, f"{path}/manifest")
        if fs.exists(old):
            fs.rename(old, cls._hadoop(spark, f"{path}/manifest-{uuid.uuid4().hex[:8]}"))
        types = StructType.fromDDL(schema)
        state = {"comparator": comparator, "schema": types.jsonValue(), "codec": codec, "last_sequence": 0, "sealed": 0, "next_file_number": 1, "files": {}, "edit_id": 0}
        store, added = cls(spark, path, state), []
        for name in filter(_RUN.fullmatch, cls._names(spark, f"{path}/data")):
            try:
                added += store._describe(name, 0, len(added) + 1)
            except Exception:  # not a readable run: left where it is
                continue
        top = max([0, *(f["largest_seq"] for f in added)])
        edit = {k: v for k, v in state.items() if k != "files"} | {"edit_id": 1, "added": added, "deleted": [], "next_file_number": len(added) + 1, "last_sequence": top, "sealed": top}
        cls._publish(spark, path, edit)
        return cls.open(spark, path, comparator=comparator)

    def collect_garbage(self, keep_versions: tuple[int, ...] = ()) -> list[str]:
        """Delete run folders that neither the current version nor a kept one refers to, and files aside that were never published; returns the folders' names."""
        live = {f["dir"] for f in self.files()}
        for v in keep_versions:
            live |= {f["dir"] for f in self._fold(self.spark, self.path, v)["files"].values()}
        fs, _ = self._fs(self.spark, self.path)
        gone = []
        for name in self._names(self.spark, f"{self.path}/data"):
            if _RUN.fullmatch(name) and name not in live and int(name.partition("-")[0]) < self._state["next_file_number"]:
                fs.delete(self._hadoop(self.spark, f"{self.path}/data/{name}"), True)
                gone.append(name)
        return gone

    # introspection

    def level_summary(self) -> list[tuple[int, int, int]]:
        """(level, files, bytes)."""
        levels: dict[int, list[int]] = {}
        for f in self.files():
            levels.setdefault(f["level"], []).append(f["file_size"])
        return [(k, len(v), sum(v)) for k, v in sorted(levels.items())]

    def statistics(self) -> DataFrame:
        """Per kind of work (write, merge, move) and level: n, and bytes read and written, over the whole manifest."""
        rows = [(w["kind"], w["level"], w["read"], w["written"]) for n in self._names(self.spark, f"{self.path}/manifest") if (m := _EDIT.fullmatch(n)) and not m[2] and (w := self._json(self.spark, f"{self.path}/manifest/{n}").get("work"))]
        table = self.spark.createDataFrame(rows, "kind string, level int, read long, written long")
        return table.groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum("read").alias("read"), F.sum("written").alias("written"))

    def approximate_size(self, low, high) -> int:
        """Bytes of the files that lie in [low, high), half of those that straddle an end."""
        total = 0
        for f in self.files():
            a, b = self._ends(f)
            if b >= low and a < high:
                total += f["file_size"] if a >= low and b < high else f["file_size"] // 2
        return total
