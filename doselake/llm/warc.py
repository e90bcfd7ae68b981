"""WARC archives: written as one gzip stream a file, normalised to a member a record, and read by offset.

Files are reached through Arrow's file systems, so the folder may be any that
Arrow knows (``file:``, ``hdfs:``, ``s3:``); it must be shared by the cluster.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from doselake.llm.common import stored
from doselake.session import scratch_path

#: Bytes moved at a time; a record of any size passes through such pieces.
PIECE = 1 << 16
#: Bytes of a header block at most; a longer one is taken as damage.
MOST_HEADER = 1 << 20
#: A digest with at least this share of the repeated rows is joined from a list, which has at most as many entries.
HOT = 1 / 1024
END = b"\r\n\r\n"
#: Fixed values of the format (WARC 1.1).
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"

MANIFEST = StructType([
    StructField("archive", StringType()), StructField("records", LongType()), StructField("bytes", LongType()),
])
INDEXED = StructType([*MANIFEST.fields, StructField("index", StringType())])
READ = StructType([
    StructField("record_id", StringType()), StructField("id", LongType()), StructField("uri", StringType()), StructField("payload_bytes", LongType()),
    StructField("payload_digest", StringType()), StructField("record_type", StringType()),
    StructField("refers_to", LongType()), StructField("payload", BinaryType()),
])


def resolve(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def spread(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df``, whose rows each stand for a file, dealt to a task a row (or to ``most`` tasks)."""
    return df.repartition(max(1, min(df.count(), most)))


# -- writing ---------------------------------------------------------------------------------------

def choose_types(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Rows to write: ``id, uri, payload`` (null for a revisit) ``, bytes, sha1, refers_to, record_type``.

    Of rows with equal payloads (equal SHA-1 and XXH64) of ``least_bytes`` or
    more, those with the largest id are responses and the others revisit it.
    Payloads are not grouped: digests are counted, and only those that repeat
    are stored and joined back. The few that hold much of the repeated rows
    come from a list of bounded size, and their rows leave the payload behind
    before any shuffle.
    """
    spark = pages.sparkSession
    payload = F.col(payload_col) if isinstance(pages.schema[payload_col].dataType, BinaryType) else F.encode(payload_col, "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(payload, F.lit(b"")).alias("payload"),
    ).withColumns({"bytes": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload")})
    key = F.when(F.col("bytes") >= least_bytes, F.struct(F.col("sha1").alias("s"), F.xxhash64("payload").alias("x")))
    counts = (
        rows.select("id", key.alias("k")).where("k IS NOT NULL").groupBy("k")
        .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL")
    )
    repeated = stored(counts, "warc-digests")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    is_hot = F.col("n") >= max(2, total * HOT)
    hot = F.broadcast(repeated.where(is_hot).select(F.col("k").alias("hot_k"), F.col("last").alias("hot_last")))
    rest = repeated.where(~is_hot).select(F.col("k").alias("rest_k"), F.col("last").alias("rest_last"))
    keyed = rows.withColumn("k", key)
    first = keyed.join(hot, F.col("k") == F.col("hot_k"), "left")
    kept = F.when(F.col("hot_last").isNull() | F.col("id").eqNullSafe(F.col("hot_last")), F.col("payload"))
    # settled rows need no second match: a key of their own keeps them apart
    own = F.struct(F.lit("").alias("s"), F.xxhash64("id", "uri").alias("x"))
    first = first.withColumns({"payload": kept, "k": F.when(F.col("hot_k").isNull() & F.col("k").isNotNull(), F.col("k")).otherwise(own)})
    both = first.join(rest, F.col("k") == F.col("rest_k"), "left").withColumn("last", F.coalesce("hot_last", "rest_last"))
    revisits = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return both.select(
        "id", "uri", F.when(~revisits, F.col("payload")).alias("payload"), "bytes", "sha1",
        F.when(revisits, F.col("last")).alias("refers_to"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
    )


def render(
    id_: int | None, uri: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None, kind: str, date: str
) -> tuple[bytes, bytes]:
    """Header block and content of a record; the content is an HTTP response, without its body for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    content = http + (payload or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{RECORD_URN}{'' if id_ is None else id_}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="%!#$&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"))
    if kind == "revisit":
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{RECORD_URN}{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(content))]
    return VERSION + "".join(f"\r\n{k}: {v}" for k, v in fields).encode() + END, content


class GzipFile:
    """A file written as one gzip stream."""

    def __init__(self, path: str, level: int):
        fs, at = resolve(path)
        self.path, self.records, self.bytes = path, 0, 0
        self.raw, self.coder = fs.open_output_stream(at, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)

    def put(self, data: bytes) -> None:
        made = self.coder.compress(data)
        if made:
            self.raw.write(made)
            self.bytes += len(made)

    def close(self) -> tuple[str, int, int]:
        made = self.coder.flush()
        self.raw.write(made)
        self.raw.close()
        return self.path, self.records, self.bytes + len(made)


def write_archives(
    rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 6, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes ``rows`` of ``choose_types`` below ``folder``; gives the manifest ``archive, records, bytes``.

    A file is one gzip stream over all of its records and ends once it holds
    ``archive_bytes``. Files have new names in each attempt of a task, and only
    those in the manifest count: a lost executor leaves files that nobody reads.
    """
    out = to_arrow_schema(MANIFEST)
    fs, at = resolve(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for i in range(batch.num_rows):
                if file is None:
                    file = GzipFile(f"{folder}/{uuid.uuid4().hex}.warc.gz", level)
                head, content = render(*(c[i].as_py() for c in batch.columns), date)
                for part in (head, content, END):
                    file.put(part)
                file.records += 1
                if file.bytes >= archive_bytes:
                    yield pa.RecordBatch.from_pylist([dict(zip(out.names, file.close(), strict=True))], out)
                    file = None
        if file is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, file.close(), strict=True))], out)

    ordered = rows.select("id", "uri", "payload", "bytes", "sha1", "refers_to", "record_type")
    return stored(ordered.mapInArrow(run, MANIFEST), "warc-written")


# -- normalising -----------------------------------------------------------------------------------

def inflate(raw: BinaryIO) -> Iterator[bytes]:
    """Plain bytes of a file: of all its gzip members in turn, or as they are when it is not compressed."""
    data = raw.read(PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = raw.read(PIECE)
        return
    coder = zlib.decompressobj(31)
    while data:
        yield coder.decompress(data, 16 * PIECE)
        data = coder.unconsumed_tail or (coder.unused_data if coder.eof else b"") or raw.read(PIECE)
        if coder.eof and data:
            coder = zlib.decompressobj(31)
    if not coder.eof:
        raise ValueError("the gzip stream breaks off")


class Plain:
    """Header blocks and contents from a stream of pieces; holds a piece or a header block."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def head(self) -> bytes | None:
        """The next header block with its empty line; None at the end."""
        while (at := self.held.find(END)) < 0:
            if len(self.held) > MOST_HEADER:
                raise ValueError("a header block is too long")
            if not self.more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("a header block breaks off")
                return None
        block, self.held = self.held[:at + 4], self.held[at + 4:]
        return block

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece."""
        while size:
            if not self.held and not self.more():
                raise ValueError("a record breaks off")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            if part:
                yield part


def fields_of(block: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name."""
    first, *lines = block.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not the start of a record: {first[:40]!r}")
    pairs = (line.partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def normalise_file(source: str, target: str, index: str, level: int) -> tuple[int, int]:
    """Rewrites ``source`` as ``target`` with a member a record, and its ``index``; gives records and bytes.

    The source is inflated once, from start to end. The index has a JSON line a
    record: where its member lies, how long it is, and the fields to find it by.
    """
    (fs, at), (to_fs, to), (index_fs, index_at) = resolve(source), resolve(target), resolve(index)
    records = offset = 0
    with fs.open_input_stream(at, compression=None) as raw, to_fs.open_output_stream(to, compression=None) as out, \
            index_fs.open_output_stream(index_at, compression=None) as lines:
        plain = Plain(inflate(raw))
        while (block := plain.head()) is not None:
            block = block.lstrip(b"\r\n")
            fields = fields_of(block)
            coder, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for part in (block, *([] if "content-length" not in fields else plain.take(int(fields["content-length"]))), END):
                made = coder.compress(part)
                out.write(made)
                length += len(made)
            made = coder.flush()
            out.write(made)
            length += len(made)
            for part in plain.take(len(END)):
                if part.strip(b"\r\n"):
                    raise ValueError(f"{source}: no end after record {records}")
            entry = {"offset": offset, "length": length} | {
                k: fields.get(f"warc-{k}") for k in ("type", "record-id", "target-uri", "payload-digest")
            }
            lines.write(json.dumps(entry).encode() + b"\n")
            records, offset = records + 1, offset + length
    return records, offset


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalises each file named in column ``archive``; gives ``archive, records, bytes, index`` of the new files.

    Files are independent, a task each. A source may be one gzip stream, many
    members, or not compressed; records of any size pass through in pieces. A
    damaged file is an error that names it.
    """
    out = to_arrow_schema(INDEXED)
    fs, at = resolve(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                index = f"{target}.index.jsonl"
                try:
                    made = normalise_file(source, target, index, level)
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{source}: {e}") from e
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, (target, *made, index), strict=True))], out)

    return stored(spread(archives.select("archive")).mapInArrow(run, INDEXED), "warc-normalised")


# -- reading ---------------------------------------------------------------------------------------

def number_of(urn: str | None) -> int | None:
    """The id that a record id of ``render`` stands for; None for any other."""
    found = (urn or "").strip("<>")
    return int(found.removeprefix(RECORD_URN)) if found.startswith(RECORD_URN) and found != RECORD_URN else None


def inflate_member(file: pa.NativeFile, offset: int, length: int) -> Iterator[bytes]:
    file.seek(offset)
    coder, left = zlib.decompressobj(31), length
    while left:
        data = file.read(min(PIECE, left))
        if not data:
            raise ValueError(f"the member at {offset} breaks off")
        left -= len(data)
        while data:
            yield coder.decompress(data, 16 * PIECE)
            data = coder.unconsumed_tail
    if not coder.eof or coder.unused_data:
        raise ValueError(f"no member of {length} bytes at {offset}")


def read_member(file: pa.NativeFile, offset: int, length: int, whole: bool) -> dict:
    """The record whose member lies at ``offset``; its payload is kept if ``whole``, and its digest made either way."""
    plain = Plain(inflate_member(file, offset, length))
    fields = fields_of(plain.head())
    kind, left, stated = fields["warc-type"], int(fields["content-length"]), {}
    if left and fields.get("content-type", "").startswith("application/http"):
        http = plain.head()
        left -= len(http)
        stated = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    sha1, size, kept = hashlib.sha1(), 0, []
    for part in plain.take(left):
        sha1.update(part)
        size += len(part)
        if whole:
            kept.append(part)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        made = base32(sha1.digest())
        if digest and digest != made:
            raise ValueError(f"the record at {offset} does not have its digest")
        digest = made
    else:
        size = int(stated["content-length"]) if "content-length" in stated else None
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "id": number_of(fields["warc-record-id"]),
        "uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest or None, "record_type": kind,
        "refers_to": number_of(fields.get("warc-refers-to")), "payload": b"".join(kept) if whole and kind == "response" else None,
    }


def read_archives(normalised: DataFrame, whole: bool = True) -> DataFrame:
    """All response and revisit records of normalised files, found by their indexes: columns of ``READ``.

    A task reads an index line by line, goes to each member and inflates that
    alone. The digest of a response is made anew from its payload; another than
    the stated one is an error. A revisit has the size and digest of the full
    payload, as its headers state them (null where they do not). Without ``whole`` payloads stay null.
    """
    out = to_arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (fs, at), (index_fs, index_at) = resolve(archive), resolve(index)
                made, size = [], 0
                with fs.open_input_file(at) as file, index_fs.open_input_stream(index_at, compression=None) as lines:
                    for entry in map(json.loads, lines_of(lines.read)):
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        made.append(read_member(file, entry["offset"], entry["length"], whole))
                        size += 200 + len(made[-1]["payload"] or b"")
                        if size > 64 * PIECE:
                            yield pa.RecordBatch.from_pylist(made, out)
                            made, size = [], 0
                yield pa.RecordBatch.from_pylist(made, out)

    return spread(normalised.select("archive", "index")).mapInArrow(run, READ)


def lines_of(read: Callable[[int], bytes]) -> Iterator[bytes]:
    held = b""
    while data := read(PIECE):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0,
    archive_bytes: int = 64 << 20,
) -> DataFrame:
    """Writes a record per row of ``pages``, normalises the files, and gives ``archive, records, bytes, index``.

    The payload is the text in UTF-8 (or the bytes), null as empty. Of rows with
    equal payloads of ``least_bytes`` or more, that with the largest id is a
    response, and the others revisit it; rows that share that id and payload
    are all responses, as are rows of a group without any id. A null id counts
    as smallest. Target URIs are percent-encoded; a null one is left out. Other
    columns are not read; an empty table gives no files. The whole folder lies
    in the shared scratch folder, and no file is ever rewritten.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    rows = choose_types(pages, id_col, uri_col, payload_col, least_bytes)
    written = write_archives(rows, f"{folder}/streams", archive_bytes)
    return normalise(written, f"{folder}/records")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as ``archive``, as ``normalise`` takes them; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("archive"))
