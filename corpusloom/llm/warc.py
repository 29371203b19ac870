"""Operator 6, WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at the end of the
file is the seek table (sizes and checksum of every frame) in Zstandard's seekable format. The index
says for every record in which archive, frame and place of that frame it is, so a reader fetches the
seek table and the frames it wants. Tasks write files under names of their own and the index, a
table committed by Spark, names those that count: what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .shared import keep, shared_folder

ship(__name__)

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value of the WARC format: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX, NO_ID = "urn:page:", "urn:no-page-id"
#: Frames that a task reads.
RUN = 32
#: Bytes of records that a task reads back.
READ_BYTES = 32 << 20


def urn(page_id) -> str:
    return NO_ID if page_id is None else PREFIX + quote(str(page_id), safe="")


def page_of(uri: str) -> str | None:
    return unquote(uri.strip("<>").removeprefix(PREFIX)) if uri.strip("<>") != NO_ID else None


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, size: int, sha1: str, refers_to, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": f"<{urn(page_id)}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else urn(page_id),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
    }
    if revisit:
        headers |= {"WARC-Refers-To": f"<{urn(refers_to)}>", "WARC-Profile": PROFILE}
    headers["Content-Type"] = "application/http; msgtype=response"
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def located(folder: str):
    """Arrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Archive:
    """One file being written: frames, then the seek table."""

    def __init__(self, folder: str, level: int):
        import zstandard

        files, path = located(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.codec, self.entries, self.size = zstandard.ZstdCompressor(level=level), [], 0

    def frame(self, data: bytes) -> None:
        import xxhash

        packed = self.codec.compress(data)
        self.out.write(packed)
        self.size += len(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, checksum) of every frame, from the end of the file."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table")
    file.seek(size - 9 - 12 * count)
    at, out = 0, []
    for packed, _, check in struct.iter_unpack("<III", file.read(12 * count)):
        out.append((at, packed, check))
        at += packed
    return out


def with_decisions(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """``page_id, url, payload, size, sha1, refers_to, revisit``. The largest id of equal payloads is found by
    combining aggregates; only payloads that occur twice are joined, and hot ones are split at run time."""
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    groups = rows.where(F.col("size") >= least).groupBy("sha1", "size")
    several = groups.agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.coalesce(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False))
    joined = rows.join(several, ["sha1", "size"], "left").withColumn("revisit", revisit)
    return joined.withColumn("refers_to", F.when(F.col("revisit"), F.col("winner"))).drop("winner")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 1000,
    frame_bytes: int = 1 << 18,
    archive_bytes: int = 1 << 28,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row under ``folder`` and return the index, kept as a table:
    ``page_id, record_type, archive, frame, offset, length``.

    Of equal payloads of at least ``least`` bytes the one with the largest id is a response, the
    others revisit it; all others are responses. A task writes archives of about ``archive_bytes``
    out of frames of about ``frame_bytes`` before compression, one frame in memory at a time.

    Null payloads are empty; a null URL is replaced by the record's name; a null id never wins over
    another; rows that repeat the winning id are responses all; other columns are ignored; an empty
    table writes no archive.
    """
    rows = with_decisions(pages, id_col, url_col, payload_col, least)
    kind = rows.schema["page_id"].dataType.simpleString()
    names = ["record_type", "archive", "frame", "offset", "length"]

    def run(batches_):
        archive, frame, held = None, [], 0  # records of the open frame, which batches share, and their bytes

        def flush():
            if frame:
                archive.frame(b"".join(frame))

        for batch in batches_:
            places = []
            columns = ("page_id", "url", "payload", "size", "sha1", "refers_to", "revisit")
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if archive is None:
                    archive = Archive(folder, level)
                    about = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
                    info = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    frame.append(record("warcinfo", info, about))
                    held = len(frame[0])
                raw = page_record(*row, date)
                places.append(("revisit" if row[6] else "response", archive.name, len(archive.entries), held, len(raw)))
                frame.append(raw)
                held += len(raw)
                if held >= frame_bytes:
                    flush()
                    frame, held = [], 0
                    if archive.size >= archive_bytes:
                        archive.close()
                        archive = None
            if places:
                arrays = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *arrays], ["page_id", *names])
        if archive is not None:
            flush()
            archive.close()

    schema = f"page_id {kind}, record_type string, archive string, frame int, offset long, length long"
    return keep(rows.mapInArrow(run, schema))


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of index rows (all or some), read from the archives:
    ``record_id, record_type, refers_to, payload_bytes, payload_digest[, payload]``.

    Runs of frames are dealt over the cluster; of each, only the frames asked for are fetched, and
    checked against the seek table. Ids come back as text. A revisit has no payload; its length and
    digest are those in its header. A response's are counted from its payload, and must agree.
    """
    placed = index.withColumn("run", F.floor(F.col("frame") / RUN))
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)
    # The work is in the archives, not in the index that is shuffled: the tasks are counted by it.
    dealt = placed.repartition(max(int(tasks), index.sparkSession.sparkContext.defaultParallelism), "archive", "run")
    runs = dealt.groupBy("archive", "run").agg(
        F.sort_array(F.collect_list(F.struct("frame", "offset", "length"))).alias("places")
    )
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
    fields += [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("payload", pa.binary())] if with_payload else []

    def one(raw: bytes) -> tuple:
        headers, block = parsed(raw)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        revisit = headers["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
        row = (page_of(headers["WARC-Record-ID"]), headers["WARC-Type"])
        row += (page_of(headers["WARC-Refers-To"]) if revisit else None, size, digest)
        return (*row, None if revisit else payload) if with_payload else row

    def run(batches_):
        import xxhash
        import zstandard

        codec = zstandard.ZstdDecompressor()
        files, path = located(folder)
        for batch in batches_:
            for name, places in zip(batch.column("archive").to_pylist(), batch.column("places").to_pylist(), strict=True):
                with files.open_input_file(f"{path}/{name}") as file:
                    table, rows, now, data = seek_table(file), [], -1, b""
                    for place in places:
                        if place["frame"] != now:
                            now = place["frame"]
                            at, size, check = table[now]
                            file.seek(at)
                            data = codec.decompress(file.read(size))
                            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                                raise ValueError(f"frame {now} of {name} is damaged")
                            if rows:
                                yield _batch(rows, fields)
                                rows = []
                        rows.append(one(data[place["offset"] : place["offset"] + place["length"]]))
                    yield _batch(rows, fields)

    kinds = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    return runs.mapInArrow(run, kinds + ", payload binary" * with_payload)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives of ``pages`` to a new shared folder, read them back, and describe every record."""
    folder = shared_folder(pages.sparkSession)
    index = write_archives(pages, folder, **options)
    kind = index.schema["page_id"].dataType
    back = read_records(index, folder, with_payload=False)
    return back.select(
        F.col("record_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
