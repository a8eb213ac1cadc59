"""WARC archives in Zstandard frames with a dictionary of their own.

Each archive starts with a skippable frame that holds the dictionary trained on
the archive's own first records; then comes one frame per record. Writer and
reader work on one archive at a time and the reader on one frame at a time, so
memory is bounded by an archive when writing and by a record when reading.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import few, stored, text_of

# Fixed values of the WARC 1.1 and the Zstandard formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
END = b"\r\n\r\n"
#: A dictionary has at most so many bytes. A record has at most RECORD: more than any text that Spark holds, with headers, so that all that is written is read.
DICTIONARY, RECORD = 1 << 26, 1 << 32


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, date: str, headers: dict[str, str | None], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date} | headers | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + END


def page_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit without the payload where refers_to is given; both name the full payload's digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record("response", record_id, date, headers, http + payload)
    return record("revisit", record_id, date, headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}, http)


def dictionary(records: list[bytes], size: int, samples: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """Trained on the starts of up to samples records, evenly spaced; the first record's start where they are too few."""
    some = [r[:sample_bytes] for r in records[:: max(1, len(records) // samples)][:samples]]
    try:
        return zstandard.train_dictionary(size, some)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(some[0][:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3, dict_bytes: int = 16384, samples: int = 200, sample_bytes: int = 8192) -> bytes:
    trained = dictionary(records, dict_bytes, samples, sample_bytes)
    compressor, raw = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True), trained.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(compressor.compress, records)])


def frames(stream, most_bytes: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame each, from a stream of its bytes. A dictionary may take DICTIONARY bytes, as written and unpacked."""

    def exactly(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("the archive ends within its dictionary")
        return data

    magic, size = struct.unpack("<II", exactly(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    if size > DICTIONARY:
        raise ValueError("the archive's dictionary is too large")
    raw = exactly(size)
    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=DICTIONARY) if raw[:4] == FRAME else raw
    reader, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    while rest or (rest := stream.read(chunk)):
        one, parts, total = reader.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(rest))
            total += len(parts[-1])
            if total > most_bytes:
                raise ValueError(f"a record of more than {most_bytes} bytes")
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := stream.read(chunk)):
                raise ValueError("the archive ends within a frame")
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """A record's headers and payload; ValueError if headers, lengths or digests are not as stated."""
    head, mark, rest = data.partition(END)
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not mark:
        raise ValueError("not a WARC record")
    h: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError("a malformed header line")
        h[name.decode().lower()] = value.decode().strip()
    if gone := [x for x in REQUIRED if x not in h]:
        raise ValueError(f"headers are missing: {', '.join(gone)}")
    if not h["content-length"].isdigit() or int(h["content-length"]) != len(rest) - len(END) or not rest.endswith(END):
        raise ValueError(f"the block of {h['warc-record-id']} is not as long as stated")
    block = rest[: -len(END)]
    if h.get("warc-block-digest", "").startswith("sha1:") and h["warc-block-digest"][5:] != digest(block):
        raise ValueError(f"the block of {h['warc-record-id']} does not match its digest")
    out = {"headers": h, "payload": None, "payload_bytes": None, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if h["warc-type"] in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(END)
        stated = [int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"]
        if not mark or len(stated) != 1:
            raise ValueError(f"{h['warc-record-id']} has no HTTP length")
        if h["warc-type"] == "response" and (stated[0] != len(payload) or out["payload_digest"] != digest(payload)):
            raise ValueError(f"the payload of {h['warc-record-id']} does not match its length or digest")
        if h["warc-type"] == "revisit" and (payload or not h.get("warc-refers-to") or not out["payload_digest"]):
            raise ValueError(f"the revisit {h['warc-record-id']} has a payload, or names none")
        out |= {"payload": payload if h["warc-type"] == "response" else None, "payload_bytes": stated[0]}
    return out


def _page(col: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("null")), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload and refers_to: null for responses, else the page_id of the response with the same payload.

    Payloads of at least least_bytes count as equal if SHA-1 and length are. Rows
    that repeat the smallest page_id are all responses; a null page_id is larger
    than any, and responses only where the group has no other id. Digests and
    lengths are shuffled, payloads are not.
    """
    rows = pages.select("page_id", "url", F.encode(text_of("html"), "UTF-8").alias("payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha1("payload"))).withColumn("_n", F.octet_length("payload"))
    groups = rows.select("_sha", "_n", "page_id").groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > 1) & (F.col("_n") >= least_bytes)).drop("_rows")
    # Only payloads that occur more than once are looked up, so payloads stay where they are unless those are too many to broadcast.
    groups = few(stored(groups, "payload-groups"))
    other = ~F.coalesce(F.col("page_id") == F.col("_first"), F.lit(False))
    return rows.join(groups, ["_sha", "_n"], "left").select("page_id", "url", "payload", F.when(other, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """(path, records): the archives of pages (page_id, url, html), when the result is written or read.

    Each partition writes archives of about archive_bytes of records to folder, a
    URI. A repeated task writes files of its own; only those that the result names
    count. Null html is empty, a null url gives no header, other columns are
    ignored, an empty table gives no archive.
    """

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, n = TaskContext.get(), 0
        records: list[bytes] = []

        def put():
            nonlocal n
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:05d}.warc.zst"
            info = record("warcinfo", f"<urn:archive:{name}>", date, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(archive([info, *records]))
            n += 1
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], "int64")})
            records.clear()
            return done

        size = 0
        for b in batches:
            for i, url, payload, to in zip(*(b.column(c) for c in ("id", "url", "payload", "to")), strict=True):
                records.append(page_record(i.as_py(), url.as_py(), payload.as_py(), to.as_py(), date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield put()
                    size = 0
        if records:
            yield put()

    rows = with_revisits(pages, least_bytes)
    rows = rows.select(_page(F.col("page_id")).alias("id"), "url", "payload", F.when(F.col("refers_to").isNotNull(), _page(F.col("refers_to"))).alias("to"))
    return rows.mapInArrow(run, "path string, records long")


def read_archives(paths: DataFrame, with_payload: bool = True, most_bytes: int = RECORD) -> DataFrame:
    """One row per record of the archives that paths (path: a URI) names.

    record_id, record_type, target_uri, refers_to, payload (null for revisits),
    payload_bytes and payload_digest as the record states them for the full
    payload. A record that fails validation ends the query with its reason, as does
    one of more than most_bytes, which no record of write_archives has. An empty
    table gives no rows.
    """

    def run(batches):
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
        kinds = dict.fromkeys(names, pa.string()) | {"payload_bytes": pa.int64(), "payload": pa.binary()}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in names], names)

        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(at) as stream:
                    for data in frames(stream, most_bytes):
                        try:
                            r = parsed(data)
                        except ValueError as e:
                            raise ValueError(f"{path}: {e}") from e
                        h = r.pop("headers")
                        rows.append(r | {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to")})
                        size += len(data) if with_payload else 200
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return paths.select("path").mapInArrow(run, schema)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id that write_archives gave to an integer page_id; null for other ids, null page_ids and texts among them."""
    found = F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found).cast("long")
