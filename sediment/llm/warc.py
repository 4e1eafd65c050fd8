"""WARC archives: a writer for fetched pages and a salvage reader.

The writer emits WARC/1.1 records, one gzip member each (or plain), into archives of bounded size
in the shared folder; a task names its files afresh, and only files that a successful task lists
in the manifest table are read. The reader streams an archive and checks every record: gzip
integrity, version line, header block, Content-Length, trailer and payload digest (hex or base32, where there is one; of an HTTP
record the payload is what follows the HTTP headers). After a failed
check it searches for the next valid member or version line, goes on from there and logs the byte
gap as quarantined, so one bad record costs that record alone.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is a
response and the rest are revisits of it; smaller payloads are always responses.

Nulls and edges: null html is an empty payload, a null url an empty target; rows with a null
page_id are written as responses and come back with a null id; repeated rows (one page_id twice)
give one record each; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.staging import new_path, partitions, stage

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20  # an archive ends with the first record that reaches this
CHUNK = 1 << 20
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
_READ = "path string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long"
_GAP = "path string, start long, stop long, reason string"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record, plain. A revisit has headers but no block; both name the full payload's digest and size."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def decide_revisits(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with payload_digest and refers_to.

    Only ids and digests meet by digest, pre-aggregated; the wide rows join that by page_id.
    """
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    narrow = stage(pages.filter("page_id is not null").select("page_id", digest.alias("payload_digest"), size.alias("size")).filter(F.col("size") >= MIN_REVISIT), "digests")
    last = narrow.groupBy("payload_digest", "size").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    last = stage(last, "digest-copies")
    copies = narrow.join(last, ["payload_digest", "size"]).filter("page_id < last_id").select("page_id", "payload_digest", F.col("last_id").alias("refers_to")).distinct()
    out = pages.select("page_id", "url", "html", digest.alias("payload_digest")).join(copies, ["page_id", "payload_digest"], "left")
    return out.select("page_id", "url", "html", "payload_digest", "refers_to")


def write_archives(decided: DataFrame, folder: str | None = None, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records and return the manifest: path, bytes, n_records of each archive."""
    folder = folder or new_path(decided.sparkSession, "warc")

    def run(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        name, out, size, n = None, None, 0, 0
        rows = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c for c in batch.columns)):
                payload = (html.as_py() or "").encode()
                data = record_bytes(page_id.as_py(), url.as_py() or "", payload, refers_to.as_py(), digest.as_py())
                data = gzip_member(data) if compress else data
                if out is None:
                    name = f"{folder}/pages-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, size, n = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    rows.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            rows.append((name, size, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "bytes", "n_records"])

    return stage(decided.mapInArrow(run, "path string, bytes long, n_records long"), "warc-manifest")


class _Source:
    """A forward window over a stream; positions count from `at`, the stream offset of its start."""

    def __init__(self, stream, data: bytes = b""):
        self.stream, self.held, self.low, self.at, self.ended = stream, data, 0, 0, stream is None

    @property
    def size(self) -> int:
        return len(self.held) - self.low

    def want(self, n: int) -> bool:
        """Whether n bytes are there, after reading as needed."""
        while self.size < n and not self.ended:
            more = self.stream.read(max(CHUNK, n - self.size))
            self.ended = not more
            self.held = self.held[self.low :] + more
            self.low = 0
        return self.size >= n

    def cut(self, a: int, b: int) -> bytes:
        return self.held[self.low + a : self.low + b]

    def find(self, mark: bytes, a: int = 0) -> int:
        k = self.held.find(mark, self.low + a)
        return k - self.low if k >= 0 else -1

    def skip(self, n: int) -> None:
        self.low, self.at = self.low + n, self.at + n


class Bad(Exception):
    pass


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Bad("version line")
    out, name = {}, None
    for line in lines[1:]:
        if name and line[:1] in (b" ", b"\t"):  # a folded line goes on
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        field, colon, value = line.partition(b":")
        if not colon or not field or b" " in field:
            raise Bad("header line")
        name = field.decode("ascii", "replace").lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def _digest(text: str) -> tuple[str | None, str | None]:
    """(kind, lower-case hex) of a digest field in hex or base32; (None, None) for one that can't be checked here."""
    kind, _, value = text.partition(":")
    kind = kind.lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(kind)
    if size is None:
        return None, None
    if len(value) == 2 * size and re.fullmatch("[0-9A-Fa-f]+", value):
        return kind, value.lower()
    try:
        raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        raw = b""
    return kind, raw.hex() if len(raw) == size else ""


def _checked(head: dict[str, str], block: bytes) -> tuple:
    kind = head.get("warc-type", "")
    payload = block
    if head.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    try:
        page = int(head["x-page-id"]) if "x-page-id" in head else None
        size = int(head.get("x-payload-length", len(payload)))
        refers = int(head["x-refers-to-page-id"]) if kind == "revisit" and "x-refers-to-page-id" in head else None
    except ValueError:
        raise Bad("header value") from None
    method, digest = _digest(head.get("warc-payload-digest", ""))
    if kind != "revisit":
        if len(payload) != size:
            raise Bad("payload length")
        if method and hashlib.new(method, payload).hexdigest() != digest:
            raise Bad("payload digest")
        digest = digest if method == "sha1" else hashlib.sha1(payload).hexdigest()
    return page, kind, size, digest, refers, payload


def _plain_record(source: _Source) -> tuple[tuple, int]:
    """(record, its length) at the window's start. A header block may be as long as it likes, but what isn't one is given up at its first bad line."""
    n, checked = 4096, 0
    source.want(n)
    while (end := source.find(b"\r\n\r\n", max(0, checked - 4))) < 0:
        known = source.cut(0, source.size).rfind(b"\r\n", checked)
        if known >= 0:
            lines = source.cut(checked, known)
            _headers(lines if not checked else b"WARC/1.1\r\nx: x\r\n" + lines)
            checked = known + 2
        elif not checked and source.cut(0, len(VERSION)) != VERSION:
            raise Bad("version line")
        if source.ended:
            raise Bad("header block")
        n *= 2
        source.want(n)
    head = _headers(source.cut(0, end))
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Bad("content length") from None
    if length < 0 or not source.want(end + 8 + length):
        raise Bad("truncated block")
    if source.cut(end + 4 + length, end + 8 + length) != b"\r\n\r\n":
        raise Bad("record trailer")
    return _checked(head, source.cut(end + 4, end + 4 + length)), end + 8 + length


def _gzip_record(source: _Source) -> tuple[tuple, int]:
    d, used, out = zlib.decompressobj(31), 0, []
    if not source.want(18) or source.cut(0, 3) != GZIP:
        raise Bad("member magic")
    step = 1 << 14
    while not d.eof:
        if not source.want(used + 1):
            raise Bad("truncated member")
        part = source.cut(used, used + step)
        try:
            out.append(d.decompress(part))
        except zlib.error:
            raise Bad("member data") from None
        used += len(part) - len(d.unused_data)
        step = CHUNK
    whole = _Source(None, b"".join(out))
    record, length = _plain_record(whole)
    if length != whole.size:
        raise Bad("member holds more than a record")
    return record, used


def salvage(stream, compressed: bool) -> Iterator[tuple]:
    """("record", offset, record) and ("gap", start, stop, reason) over a binary stream, in order of bytes.

    A candidate start after damage counts only if a whole valid record stands there. Memory is bounded
    by the largest record (a false Content-Length can make the window as long as the archive, which the
    writer bounds).
    """
    source = _Source(stream)
    one, mark = (_gzip_record, GZIP) if compressed else (_plain_record, VERSION)
    gap, reason = None, ""
    while source.want(1):
        try:
            record, length = one(source)
        except Bad as e:
            if gap is None:
                gap, reason = source.at, str(e)
            k, at = source.find(mark, 1), 1
            while k < 0:
                at = max(at, source.size - len(mark) + 1)
                if not source.want(source.size + 1):
                    k = source.size
                    break
                k = source.find(mark, at)
            source.skip(k)
            continue
        if gap is not None:
            yield "gap", gap, source.at, reason
            gap = None
        yield "record", source.at, record
        source.skip(length)
    if gap is not None:
        yield "gap", gap, source.at, reason


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives in column `path`, and quarantined gaps (record_type "quarantined", with reason and stop)."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = _fs(path)
                rows = []
                with fs.open_input_stream(inner, compression=None) as stream:
                    for what, at, *more in salvage(stream, path.endswith(".gz")):
                        if what == "gap":
                            rows.append((path, None, "quarantined", None, None, None, at, more[0], more[1], None))
                        else:
                            page, kind, size, digest, refers, block = more[0]
                            rows.append((path, page, kind, size, digest, refers, at, None, None, block if payloads else None))
                        if len(rows) >= (64 if payloads else 5000):
                            yield _batch(rows, payloads)
                            rows = []
                if rows:
                    yield _batch(rows, payloads)

    return paths.select("path").mapInArrow(run, _READ + ", stop long, reason string" + ", payload binary" * payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["path", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "offset", "stop", "reason", "payload"]
    k = len(names) - (not payloads)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows), kinds))[:k]], names[:k])


def split_quarantine(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of what `read_archives` gives, both from one written table; gaps are logged and counted, never lost."""
    whole = stage(read, "warc-read")
    gaps = whole.filter("record_type = 'quarantined'").select("path", F.col("offset").alias("start"), "stop", "reason")
    n, size = gaps.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    if n:
        logging.getLogger(__name__).warning("%d byte gaps of %d bytes are quarantined in %s", n, size, whole.staged_path)
    return whole.filter("record_type <> 'quarantined'"), gaps


def op3_warc_salvage(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(decide_revisits(pages))
    paths = manifest.select("path").repartition(partitions(spark), "path")
    records, _ = split_quarantine(read_archives(paths))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.last_id > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last_id > p.page_id THEN g.last_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
