"""A deterministic sharded writer of WARC archives, and the reader that gives the records back.

Records are sorted by (key, payload digest, url). Every ``SHARD_BYTES`` of payload, on average, a new
shard begins; the bounds come from exact ranks, so they depend on the records alone and not on how
Spark has dealt them. A task writes its shards one after the other and starts a new file when the
compressed size reaches ``FILE_BYTES``. Headers and digests are made anew from the payload; ids are
hashes and the date is a parameter, so the same records give the same bytes.

Commit: a task writes under ``_temporary`` with a name of its own attempt, and reports file, size and
digest. Only reported files are moved to their names, by a second job that can be repeated; then the
manifest is written, and ``read`` opens only files that the manifest names. A lost executor leaves
files nobody names.

Payloads of ``LEAST_BYTES`` or more that occur under several keys: the largest key is a response, the
others are revisits of it, without payload. Rows that repeat key and payload have one type; the rows
of the largest key are all responses. Null payload and null url are empty. Null keys come first in
order, are never revisited, and are responses. An empty table gives a manifest without files.

Paths are URIs that ``pyarrow.fs`` and Spark both open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import checkpointed
from scoreflow.llm.common import ranked

LEAST_BYTES = 1000
SHARD_BYTES = 16 << 20
FILE_BYTES = 16 << 20
MOST_SHARDS = 65_536
MOST_TASKS = 4096
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16
FILES = "shard long, number int, temporary string, name string, records long, bytes long, sha256 string"
RECORD = ("name string, offset long, type string, id string, key long, url string, refers_to string, "
          "declared string, digest string, bytes long, payload binary")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` and plain paths are local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record_id(kind: str, key: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{key}|{digest}|{url}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    # A url can hold no line break inside a header.
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields],
             f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def _line(text: str) -> str:
    """Text that stays within a header line; ``unline`` inverts it."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in text for c in "%\r\n") else text


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(key: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The response or revisit record of a row."""
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Record-ID", record_id(kind, key, digest, url)), ("WARC-Date", date),
              ("WARC-Target-URI", _line(url)), ("WARC-Identified-Payload-Type", "text/html"),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("Content-Type", "application/http;msgtype=response"),
              ("X-Key", "" if key is None else str(key))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return member(kind, fields, head + payload)
    fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Key", str(refers_to))]
    return member(kind, fields, head)


class Roll:
    """The files of one shard, under temporary names of this attempt."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.files, self.root = opened(folder)
        self.shard, self.most, self.date = shard, file_bytes, date
        context = TaskContext.get()
        self.attempt = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex}"
        self.number, self.out, self.done = -1, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(data, 1)
        if self.size >= self.most:
            self.close()

    def _put(self, data: bytes, records: int) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += records

    def _open(self) -> None:
        self.number += 1
        self.name = f"{self.shard:05d}-{self.number:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{self.attempt}"
        self.files.create_dir(posixpath.join(self.root, "_temporary"), recursive=True)
        self.out = self.files.open_output_stream(posixpath.join(self.root, self.temporary), compression=None)
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        block = f"software: sharded writer\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self._put(member("warcinfo", [("WARC-Record-ID", record_id("warcinfo", self.number, self.name, "")),
                                      ("WARC-Date", self.date), ("WARC-Filename", self.name),
                                      ("Content-Type", "application/warc-fields")], block), 0)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.shard, self.number, self.temporary, self.name, self.records, self.size, self.sha.hexdigest()))


def _file_rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["shard", "number", "temporary", "name", "records", "bytes", "sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)


def _write_batches(folder: str, file_bytes: int, date: str):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, revisit = None, None
        for batch in rows:
            columns = [batch[c] for c in ("shard", "key", "url", "payload", "digest", "refers_to")]
            for shard, key, url, payload, digest, refers in zip(*columns):
                name = key.as_py(), digest.as_py()
                if refers.is_valid:  # no record, but what the records of this key and digest revisit
                    revisit = *name, refers.as_py()
                    continue
                if roll is None or roll.shard != shard.as_py():
                    if roll:
                        roll.close()
                        yield _file_rows(roll.done)
                    roll = Roll(folder, shard.as_py(), file_bytes, date)
                refers_to = revisit[2] if revisit and revisit[:2] == name else None
                roll.add(record(*name[:1], url.as_py(), payload.as_py(), name[1], refers_to, date))
        if roll:
            roll.close()
            yield _file_rows(roll.done)
    return batches


def _commit_batches(folder: str):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for batch in rows:
            for at, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist()):
                old, new = posixpath.join(root, at), posixpath.join(root, name)
                # A repeated task finds its file moved already.
                if files.get_file_info(old).type != fs.FileType.NotFound:
                    files.move(old, new)
                elif files.get_file_info(new).type == fs.FileType.NotFound:
                    raise FileNotFoundError(new)
            yield batch
    return batches


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Columns ``key, url, payload, digest, bytes`` of every row: what is to be written."""
    rows = pages.select(pages[key].cast("long").alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"),
                        F.encode(F.coalesce(pages[payload].cast("string"), F.lit("")), "utf-8").alias("payload"))
    return rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))


def revisits(narrow: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Columns ``key, digest, refers_to`` of the records that revisit another; from ``key, digest, bytes``."""
    large = narrow.where(F.col("bytes") >= least)
    shared = large.groupBy("digest").agg(F.max("key").alias("refers_to"), F.min("key").alias("first")).where("first < refers_to")
    return large.join(shared, "digest").where("key < refers_to").select("key", "digest", "refers_to").distinct()


def write(rows: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
          date: str = DATE, least: int = LEAST_BYTES) -> DataFrame:
    """Write ``records`` to ``folder``; returns the manifest, which is written last.

    Payloads are shuffled once; what a record revisits travels to its shard as a row of its own.

    A shard has as many keys as make ``shard_bytes`` of payload on average (at most 65,536 shards,
    whose bounds are broadcast); rows that share key and payload stay in one shard.
    """
    spark = rows.sparkSession
    seen = checkpointed(rows.select(F.lit(0).alias("one"), "key", "digest", "bytes"))
    narrow = ranked(seen, ["one"], ["key", "digest"])
    total, count = narrow.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    each = max(1, count * shard_bytes // max(1, total or 1), -(-count // MOST_SHARDS))
    # The first row of each shard; nulls are before all keys.
    bounds = sorted((k is not None, k or 0, d) for k, d in
                    narrow.where(F.col("rank") % each == 0).select("key", "digest").toLocalIterator())
    keys = np.array([k if known else np.iinfo(np.int64).min for known, k, _ in bounds], np.int64)
    shared = spark.sparkContext.broadcast((keys, [d for _, _, d in bounds]))

    def shards(column_key, column_digest):
        first, digests = shared.value
        low = np.searchsorted(first, column_key, "left")
        high = np.searchsorted(first, column_key, "right")
        for i in np.flatnonzero(high > low):  # a bound has this key: the digest decides
            at = high[i]
            while at > low[i] and digests[at - 1] > column_digest[i]:
                at -= 1
            high[i] = at
        return np.maximum(high - 1, 0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["key"].fill_null(np.iinfo(np.int64).min).to_numpy()
            shard = shards(at, batch["digest"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *batch.columns],
                                             names=["shard", *batch.schema.names])

    marks = revisits(seen, least).select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                                         "digest", "refers_to")
    wide = rows.select("key", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to")).unionAll(marks)
    wide = wide.mapInArrow(placed, "shard long, key long, url string, payload binary, digest string, refers_to long")
    wide = wide.repartition(max(1, min(len(bounds), MOST_TASKS)), "shard").sortWithinPartitions(
        "shard", "key", "digest", F.col("refers_to").desc_nulls_last(), "url")
    written = checkpointed(wide.mapInArrow(_write_batches(folder, file_bytes, date), FILES))
    moved = checkpointed(written.repartition("name").mapInArrow(_commit_batches(folder), FILES))
    moved.drop("temporary").write.parquet(posixpath.join(folder, "manifest"))
    files, root = opened(folder)
    if files.get_file_info(posixpath.join(root, "_temporary")).type != fs.FileType.NotFound:
        files.delete_dir(posixpath.join(root, "_temporary"))
    return spark.read.parquet(posixpath.join(folder, "manifest"))


def remove(folder: str) -> None:
    """Delete a folder of archives."""
    files, root = opened(folder)
    files.delete_dir(root)


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream; one member is held at a time."""
    start = at = 0
    packer, parts, data = zlib.decompressobj(31), [], stream.read(READ_BYTES)
    while data:
        parts.append(packer.decompress(data))
        at += len(data) - len(packer.unused_data)
        data = packer.unused_data
        if packer.eof:
            yield start, b"".join(parts)
            start, packer, parts = at, zlib.decompressobj(31), []
        data = data or stream.read(READ_BYTES)
    if start != at:
        raise ValueError("the last record is cut off")


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with the type line as "", and the block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {"": first} | dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[:int(fields["Content-Length"])]


def _read_batches(folder: str, with_payload: bool):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
             pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for batch in rows:
            for name in batch["name"].to_pylist():
                held: list[tuple] = []
                size = 0
                with files.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for offset, content in members(stream):
                        fields, block = parsed(content)
                        if fields["WARC-Block-Digest"] != _digest(block):
                            raise ValueError(f"{name} at {offset}: the block does not have its digest")
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        full = fields["WARC-Type"] == "response"
                        declared = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        held.append((name, offset, fields["WARC-Type"], fields["WARC-Record-ID"],
                                     int(fields["X-Key"]) if fields["X-Key"] else None, _unline(fields["WARC-Target-URI"]),
                                     fields.get("X-Refers-To-Key"), declared,
                                     hashlib.sha1(payload).hexdigest() if full else None,
                                     len(payload) if full else None, payload if full and with_payload else None))
                        size += len(payload) if with_payload else 256
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
    return batches


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the files in the manifest: their place, headers, and digest and bytes of what was read.

    ``declared`` is the payload digest of the header. Revisits have no payload of their own.
    """
    files = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("name").repartition(files, "name").mapInArrow(_read_batches(folder, with_payload), RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Columns ``key, bytes, digest, type, refers_to`` of records read, revisits with those of their response."""
    full = found.where("type = 'response'").select(
        F.col("key").cast("string").alias("refers_to"), F.col("digest").alias("whole"), F.col("bytes").alias("long")).distinct()
    seen = found.where("type = 'revisit'").drop("digest", "bytes").join(
        full, (found["refers_to"] == full["refers_to"]) & (found["declared"] == full["whole"])).drop(full["refers_to"])
    return found.where("type = 'response'").select("key", "bytes", "digest", "type", F.lit(None).cast("long").alias("refers_to")).unionAll(
        seen.select("key", F.col("long").alias("bytes"), F.col("whole").alias("digest"), "type",
                    F.col("refers_to").cast("long").alias("refers_to")))
