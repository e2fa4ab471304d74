"""WARC archives by way of a chunked record table.

Payloads leave the scan as chunk rows (digest, length, chunk number, bytes) of at
most ``chunk`` bytes; only chunks are shuffled, and only those of payloads that
become a response. Of equal payloads one set of chunks leaves a task of the scan
as a rule (the last few thousand digests are remembered), and the writer passes
over those that come again. Chunks are dealt and sorted by (digest, length,
number); the row that says which record the response is sorts in front of them.
The writer opens the record there, puts every chunk through the digest and the
compressor as it comes, and closes the record after the last: it holds one
chunk, never a record. The reader works the same way on the archive: inflated in
pieces, digested in pieces.

Which record of equal payloads is the response is decided on narrow rows (id,
url, digest, length), counted by all four: of a digest the largest id, of its
rows the one with the largest url, of fully equal rows one. All others are
revisits, written without a payload. Digests of very many pages are few, so they
are joined by broadcast (at most one for every ``HOT`` pages); the rest is a
shuffle join. Counts become rows in two steps, so not in one task.

File names hold a random part and the manifest (a written table with a row a
file) lists only files of tasks that ended well.

Defined results: a null payload is an empty one; of equal payloads of at least
``min_bytes`` bytes one record is the response, one with the largest id, and all
others refer to its id, also those with the same id; smaller ones are responses
each; a null id is less than any other (it is the response if the group has no
other id); an empty table gives no archives and no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.common import new_dir, open_fs, written

CHUNK, FILE_BYTES, LEVEL = 1 << 18, 1 << 30, 3
#: Pages of a digest from which it is joined by broadcast, rows a count becomes at once, digests a scan task remembers.
HOT, AT_ONCE, REMEMBERED = 100_000, 10_000, 4096
RECORD = "digest string, bytes bigint, chunk_no int, record_id bigint, url string, refers_to bigint, data binary"
FILE = "path string, records bigint, bytes bigint"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


class ArchiveWriter:
    """Records, each a gzip member of its own, in files of up to ``file_bytes``."""

    def __init__(self, folder: str, name: str, file_bytes: int):
        self.folder, self.name, self.file_bytes = folder, name, file_bytes
        self.files: list[tuple[str, int, int]] = []
        self.out, self.size, self.records = None, 0, 0

    def begin(self, record_id: int | None, url: str | None, response: bool, refers_to: int | None, digest: str, n: int) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{self.name}-{len(self.files):04d}.warc.gz"
            fs, at = open_fs(self.path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            self.out, self.size, self.records = fs.open_output_stream(at), 0, 0
        self.zip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.sha, self.left, self.digest = hashlib.sha1(), n if response else 0, digest
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        fields = [
            ("WARC-Type", "response" if response else "revisit"),
            ("WARC-Record-ID", f"<urn:record:{'null' if record_id is None else record_id}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")),
            ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        if not response:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:record:{refers_to}>")]
        fields.append(("Content-Length", str(len(http) + self.left)))
        self.put(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http)

    def put(self, data: bytes) -> None:
        if packed := self.zip.compress(data):
            self.out.write(packed)
            self.size += len(packed)

    def payload(self, data: bytes) -> None:
        self.sha.update(data)
        self.left -= len(data)
        self.put(data)

    def end(self, response: bool) -> None:
        if response and (self.left or self.sha.hexdigest() != self.digest):
            raise ValueError("the chunks of a record don't make up its payload")
        self.put(b"\r\n\r\n")
        self.out.write(packed := self.zip.flush())
        self.size += len(packed)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.path, self.records, self.size))
            self.out = None


def _write(folder: str, file_bytes: int):
    """Rows of RECORD, a record's in order: its head (chunk_no -1) and, for a response, its chunks; chunks that come again are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        to = ArchiveWriter(folder, f"part-{part:06d}-{uuid.uuid4().hex}", file_bytes)
        left, wanted = 0, -1
        for batch in batches:
            digest, size, chunk_no, record_id, url, refers_to = (c.to_pylist() for c in batch.columns[:6])
            for i, data in enumerate(batch.column(6)):
                if chunk_no[i] < 0:
                    response = refers_to[i] is None
                    to.begin(record_id[i], url[i], response, refers_to[i], digest[i], size[i])
                    left, wanted = size[i] if response else 0, 0
                    if not left:
                        to.end(response)
                elif left and chunk_no[i] == wanted:
                    to.payload(piece := data.as_buffer())
                    left, wanted = left - piece.size, wanted + 1
                    if not left:
                        to.end(True)
        to.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([f[0] for f in to.files], pa.string()), "records": pa.array([f[1] for f in to.files], pa.int64()), "bytes": pa.array([f[2] for f in to.files], pa.int64())})

    return run


def _chunks(least: int, chunk: int, heads: bool):
    """Chunk rows of payloads of ``least`` bytes and more; with ``heads``, of smaller ones, each a record of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "bytes", "chunk_no", "record_id", "url", "refers_to", "data"])

        for batch in batches:
            rows, held = [], 0
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, payload in enumerate(batch.column(2)):
                raw = payload.as_buffer()
                if (raw.size < least) != heads:
                    continue
                digest = hashlib.sha1(raw)
                if heads:
                    rows.append((digest.hexdigest(), raw.size, -1, ids[i], urls[i], None, None))
                elif digest.digest() in seen:
                    continue
                else:
                    seen[digest.digest()] = None
                    if len(seen) > REMEMBERED:
                        del seen[next(iter(seen))]
                for n, at in enumerate(range(0, raw.size, chunk)):
                    rows.append((digest.hexdigest(), raw.size, n, None, None, None, raw.slice(at, min(chunk, raw.size - at)).to_pybytes()))
                    held += chunk
                    if held >= 1 << 24:
                        yield table(rows)
                        rows, held = [], 0
            yield table(rows)

    return run


def record_plan(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(heads, revisits): a row a payload with its response record; a row each other record, with refers_to. Payloads of ``min_bytes`` and more only."""
    narrow = pages.select("record_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes")).filter(F.col("bytes") >= min_bytes)
    tuples = written(narrow.groupBy("digest", "bytes", "record_id", "url").count(), "warc-tuples")
    grouped = tuples.groupBy("digest", "bytes").agg(F.max(F.struct("record_id", "url")).alias("head"), F.sum("count").alias("pages"), F.count("*").alias("kinds"))
    heads = written(grouped, "warc-heads")
    hot = F.col("kinds") >= HOT
    common = F.broadcast(heads.filter(hot & (F.col("pages") > 1)).select("digest", "bytes", "head"))
    rare = heads.filter(~hot & (F.col("pages") > 1)).select("digest", "bytes", "head")
    often = tuples.join(common, ["digest", "bytes"])
    seldom = tuples.join(common, ["digest", "bytes"], "left_anti").join(rare, ["digest", "bytes"])
    own = F.col("record_id").eqNullSafe(F.col("head.record_id")) & F.col("url").eqNullSafe(F.col("head.url"))
    others = often.unionByName(seldom).select("digest", "bytes", "record_id", "url", F.col("head.record_id").alias("refers_to"), (F.col("count") - own.cast("int")).alias("n")).filter("n > 0")
    parts = others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / AT_ONCE))))
    dealt = parts.repartition("digest", "record_id", "url", "part")
    copies = F.least(F.col("n") - F.col("part") * AT_ONCE, F.lit(AT_ONCE)).cast("int")
    revisits = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("part", "copy", "n")
    return heads.select("digest", "bytes", "head.record_id", "head.url"), revisits


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, chunk: int = CHUNK, file_bytes: int = FILE_BYTES, folder: str | None = None) -> DataFrame:
    """Write the archives; the manifest: path, records, bytes."""
    folder = folder or new_dir(pages.sparkSession, "warc")
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    used = pages.select(F.col(page_id).cast("bigint").alias("record_id"), F.col(url).alias("url"), data.alias("payload"))
    heads, revisits = record_plan(used, min_bytes)
    names = [c.split()[0] for c in RECORD.split(", ")]
    front = heads.withColumns({"chunk_no": F.lit(-1), "refers_to": F.lit(None).cast("bigint"), "data": F.lit(None).cast("binary")}).select(names)
    order = ["digest", "bytes", "chunk_no"]
    responses = front.unionByName(used.mapInArrow(_chunks(min_bytes, chunk, False), RECORD)).repartition("digest", "bytes").sortWithinPartitions(*order)
    again = revisits.withColumns({"chunk_no": F.lit(-1), "data": F.lit(None).cast("binary")}).select(names)
    parts = [responses, again, *([used.mapInArrow(_chunks(min_bytes, chunk, True), RECORD)] if min_bytes else [])]
    files = [written(part.mapInArrow(_write(f"{folder}/{k}", file_bytes), FILE), f"warc-manifest-{k}") for k, part in enumerate(parts)]
    out = files[0]
    for part in files[1:]:
        out = out.unionByName(part)
    return out


class ArchiveReader:
    """Records of an archive, payloads digested in pieces."""

    def __init__(self, path: str, piece: int = CHUNK):
        fs, at = open_fs(path)
        self.piece = piece
        self.file = io.BufferedReader(_Inflated(fs.open_input_stream(at), piece), piece)

    def fields(self) -> dict[str, str]:
        found = {}
        while line := self.file.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            found[name.decode().lower()] = value.strip().decode()
        return found

    def __iter__(self) -> Iterator[dict]:
        while line := self.file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = self.fields()
            left = int(head["content-length"])
            at = self.file.readline()
            http = self.fields()
            left -= len(at) + sum(len(k) + len(v) + 4 for k, v in http.items()) + 2
            sha, n = hashlib.sha1(), 0
            while left:
                if not (data := self.file.read(min(left, self.piece))):
                    raise ValueError("a record is cut short")
                sha.update(data)
                n += len(data)
                left -= len(data)
            digest, response = head["warc-payload-digest"].partition(":")[2], head["warc-type"] == "response"
            if response and digest != base64.b32encode(sha.digest()).decode():
                raise ValueError("a payload doesn't have its digest")
            number = lambda x: None if x in ("", "null") else int(x)
            name = lambda f: number(head.get(f, "").strip("<>").rpartition(":")[2])
            yield {"page_id": name("warc-record-id"), "payload_bytes": n if response else int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": name("warc-refers-to")}


class _Inflated(io.RawIOBase):
    """The members of a gzip stream, end to end."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece = stream, piece
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            data = self.rest or self.stream.read(self.piece)
            if not data:
                return 0
            out = self.inflate.decompress(data, len(buffer))
            self.rest = self.inflate.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)


READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for row in ArchiveReader(path):
                rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the listed files."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "path").select("path").mapInArrow(_read, READ_SCHEMA)
