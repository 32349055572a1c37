"""Zstandard WARC archives: writer, reader and payload deduplication.

An archive starts with a skippable frame that carries the zstandard
dictionary; then each record is a frame of its own, so records can be decoded
one by one.  The reader loads the dictionary from that frame, walks the frames
by their block headers, decodes one frame per record, and checks the version
line, the mandatory fields, the declared length and the payload's digest.

Payloads of at least ``min_bytes`` that occur more than once are written once:
the record with the largest id is the response, the others are revisits that
refer to it.  Groups are found by one aggregate on the payload's SHA-256.

Defined results: a null payload is empty; a null id is written as ``null`` and
read back as null, and never is the one that others revisit unless all ids of
its group are null; rows that repeat the largest id all stay responses; an
empty table gives no archive and an empty frame; extra columns are ignored.
An archive is closed after ``ARCHIVE_BYTES`` of raw records, so the memory of
writer and reader is that plus one record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixdetect.plans.session import ensure_checkpoint_dir

from .common import stored

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSIONS = ("WARC/1.0", "WARC/1.1")
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16_000_000
#: Bound of the rows and bytes that the dictionary is trained on.
DICTIONARY_ROWS, DICTIONARY_ROW_BYTES, DICTIONARY_BYTES = 200, 20_000, 65_536


class WarcError(ValueError):
    """A malformed archive or record."""


# -- format ------------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary in it is itself compressed."""
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed


def frame_end(data: memoryview, start: int) -> int:
    """End of the zstandard frame at ``start``, by its header and block headers."""
    if bytes(data[start:start + 4]) != FRAME_MAGIC:
        raise WarcError(f"no zstandard frame at byte {start}")
    try:
        params = zstandard.get_frame_parameters(data[start:start + 18])
        at = start + zstandard.frame_header_size(data[start:start + 18])
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header at byte {start}: {e}") from e
    last = False
    while not last:
        if at + 3 > len(data):
            raise WarcError(f"the frame at byte {start} is cut off")
        head = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * bool(params.has_checksum)
    if at > len(data):
        raise WarcError(f"the frame at byte {start} is cut off")
    return at


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every record frame of an archive."""
    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else None
        if magic is not None and SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            size = struct.unpack_from("<I", data, at + 4)[0]
            body = bytes(data[at + 8:at + 8 + size])
            if len(body) < size:
                raise WarcError("the skippable frame is cut off")
            if at == 0 and magic == SKIPPABLE_DICTIONARY:
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        end = frame_end(data, at)
        try:
            yield at, decoder.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one decoded record; raises WarcError if it is malformed."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the header has no end")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version not in VERSIONS:
        raise WarcError(f"unknown version line {version!r:.40}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line!r:.80}")
        fields[name.strip()] = value.strip()
    if missing := [m for m in MANDATORY if m not in fields]:
        raise WarcError(f"missing fields: {missing}")
    if not fields["Content-Length"].isdigit():
        raise WarcError(f"bad length {fields['Content-Length']!r:.40}")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"declared {n} bytes, the frame holds {len(rest) - 4}")
    return fields, rest[:n]


def make_record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _one_line(s: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in s or "")


def _record_id(number) -> str:
    return f"<urn:record:{'null' if number is None else int(number)}>"


# -- writer ------------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    elif uri.startswith("/"):
        uri = "file://" + uri
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def train_dictionary(pages: DataFrame, id_col: str, payload_col: str) -> bytes:
    """Dictionary from at most DICTIONARY_ROWS payloads (in hash order) of at most DICTIONARY_ROW_BYTES."""
    sized = (pages.where(F.octet_length(payload_col).between(64, DICTIONARY_ROW_BYTES))
             .select(F.xxhash64(F.col(id_col), F.col(payload_col)).alias("h"), F.col(payload_col).alias("p")))
    # the hashes are chosen first, so that no task sends more payloads than are wanted
    chosen = [r["h"] for r in sized.select("h").distinct().orderBy("h").limit(DICTIONARY_ROWS).collect()]
    few = sized.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).collect() if chosen else []
    samples = [r["p"].encode("utf-8", "surrogatepass") for r in sorted(few, key=lambda r: r["h"])]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples
        return b""


def plan_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                 min_bytes: int = 1000) -> DataFrame:
    """(id, uri, payload, kind, refers_to): which rows are written as responses and which as revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    large = F.octet_length("payload") >= min_bytes
    # small payloads get a key of their own, so that they spread over the tasks of the join
    keyed = rows.withColumn("key", F.when(large, F.sha2("payload", 256)).otherwise(
        F.concat(F.lit("-"), F.xxhash64("id", "payload").cast("string"))))
    kept = (keyed.where(large).groupBy("key").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
            .where("n > 1").select(F.col("key").alias("k"), "keeper"))
    joined = keyed.join(kept, F.col("key") == F.col("k"), "left")
    again = F.col("k").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    return joined.select("id", "uri", "payload", F.when(again, "revisit").otherwise("response").alias("kind"),
                         F.when(again, F.col("keeper")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, dictionary: bytes = b"", date: str = "2000-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write planned records to ``folder``; returns (path, n_records, n_bytes), written already.

    Rows are sorted within a partition and names follow from it, so a repeated
    task writes the same files; each appears whole, by a rename.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        comp = zstandard.ZstdCompressor(level=level, write_checksum=True,
                                        **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        out, done, raw, n = bytearray(), [], 0, 0

        def close() -> None:
            nonlocal out, raw, n
            name = f"{root}/part-{part:06d}-{len(done):05d}.warc.zst"
            temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary) as f:
                f.write(bytes(out))
            fs.move(temporary, name)
            done.append((name, n, len(out)))
            out, raw, n = bytearray(), 0, 0

        for b in batches:
            cols = [b.column(c) for c in ("id", "uri", "payload", "kind", "refers_to")]
            for k in range(b.num_rows):
                number, uri, payload, kind, target = (c[k].as_py() for c in cols)
                record = make_record(kind, _record_id(number), _one_line(uri), date,
                                     payload.encode("utf-8", "surrogatepass"),
                                     _record_id(target) if kind == "revisit" else None)
                if not n and dictionary:
                    out += dictionary_frame(dictionary)
                out += comp.compress(record)
                raw, n = raw + len(record), n + 1
                if raw >= archive_bytes:
                    close()
        if n:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    ordered = records.sortWithinPartitions(F.col("id").asc_nulls_last(), "kind", F.xxhash64("uri", "payload"))
    return stored(ordered.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-written")


# -- reader ------------------------------------------------------------------------------------

RECORD_SCHEMA = ("path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, "
                 "payload_digest string, payload_bytes long, payload binary, error string")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, on_error: str = "raise") -> DataFrame:
    """One row per record of the ``*.warc.zst`` files of a folder.

    ``payload_digest`` is hex SHA-1, recomputed from the payload of a response
    and compared with the declared one.  ``on_error="row"`` gives a row with
    ``error`` for what can't be read (the rest of an archive is given up after
    a broken frame); otherwise the read fails.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")

    def record(path: str, offset: int, raw: bytes) -> tuple:
        fields, block = parse_record(raw)
        kind = fields["WARC-Type"]
        http, _, payload = block.partition(b"\r\n\r\n")
        n = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
        declared = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        if kind == "response":
            if n != len(payload):
                raise WarcError(f"the payload declares {n} bytes and has {len(payload)}")
            found = hashlib.sha1(payload).hexdigest()
            if declared and declared != found:
                raise WarcError("the payload's digest is not the declared one")
            declared = found
        return (path, offset, kind, fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"),
                declared, n, payload if with_payload and kind == "response" else None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows: list[tuple] = []
                offset, size = 0, 0
                try:
                    for offset, raw in frames(content):
                        try:
                            rows.append(record(path, offset, raw))
                        except WarcError as e:
                            if on_error != "row":
                                raise
                            rows.append((path, offset, *[None] * 7, str(e)))
                        size += len(raw) if with_payload else 200
                        if size > ARCHIVE_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                except WarcError as e:
                    if on_error != "row":
                        raise WarcError(f"{path}, byte {offset}: {e}") from e
                    rows.append((path, offset, *[None] * 7, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    return files.mapInPandas(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    dictionary = train_dictionary(pages, "page_id", "html")
    write_archives(plan_records(pages), folder, dictionary)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:record:(.*)>', 1) as bigint)")
    return read_archives(spark, folder, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"), F.element_at(F.split("path", "/"), -1).alias("archive"), "offset")
