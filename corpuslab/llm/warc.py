"""WARC archives as seekable Zstandard bundles.

A bundle is the bytes of one ``.warc.zst`` file: independent Zstandard frames of
a few records each, then a skippable frame with the seek table (compressed and
decompressed size of every frame, number of frames, a descriptor, a magic number).
The index maps each record to its frame and its offset within that frame, so that
one record is read by decompressing one frame. Bundles are written as rows of a
Parquet table on the shared store, which survives executors and needs no local
paths; :func:`export_bundle` gives the bytes to any file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import bounded_batches, saved

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
#: Payloads below this are never revisited; bytes of a frame and of a bundle before compression.
LEAST, FRAME, BUNDLE = 100, 1 << 18, 1 << 23
INDEX = "array<struct<record_id: string, frame: int, offset: int, length: int>>"


def record_id(page_id: int | None, number: int) -> str:
    """``number`` is the row's own, so that rows of one page id have different records."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{number}>"


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, an HTTP message around the payload, or, if it refers to another record, a revisit without a body."""
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if clean is not None:
        lines.append("WARC-Target-URI: " + clean)
    body = b""
    if refers_to is None:
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def pack(records: list[tuple[str, bytes]], frame: int = FRAME) -> tuple[bytes, list[dict]]:
    """The bundle's bytes and its index."""
    packer = zstandard.ZstdCompressor(level=3)
    out, table, index, buffer = [], [], [], []
    size = 0

    def close():
        nonlocal buffer, size
        if buffer:
            raw = b"".join(buffer)
            out.append(packer.compress(raw))
            table.append((len(out[-1]), len(raw)))
            buffer, size = [], 0

    for name, data in records:
        if size and size + len(data) > frame:
            close()
        index.append({"record_id": name, "frame": len(table), "offset": size, "length": len(data)})
        buffer.append(data)
        size += len(data)
    close()
    seek = b"".join(struct.pack("<II", *x) for x in table) + struct.pack("<IBI", len(table), 0, SEEKABLE)
    return b"".join([*out, struct.pack("<II", SKIPPABLE, len(seek)), seek]), index


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed size, decompressed size)`` of the frames, from the seek table in the footer."""
    n, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or descriptor:
        raise ValueError("no seek table")
    at = len(bundle) - 9 - 8 * n
    if struct.unpack("<II", bundle[at - 8 : at]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("the seek table's frame is damaged")
    out, start = [], 0
    for i in range(n):
        packed, raw = struct.unpack("<II", bundle[at + 8 * i : at + 8 * i + 8])
        out.append((start, packed, raw))
        start += packed
    return out


def seek(bundle: bytes, entry: dict) -> bytes:
    """One record, by its index entry: a single frame is decompressed."""
    start, packed, raw = frames(bundle)[entry["frame"]]
    data = zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=raw)
    return data[entry["offset"] : entry["offset"] + entry["length"]]


def export_bundle(row, path: str) -> None:
    """Write a bundle row as a ``.warc.zst`` file at a mounted path."""
    with open(path, "wb") as f:
        f.write(row["data"])


def _bundles(limit: int, frame: int):
    def closed(records):
        data, index = pack(records, frame)
        return pd.DataFrame({"bundle_id": [uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(data).hexdigest()).hex], "data": [data], "index": [index]})

    def run(parts):
        records, size = [], 0
        whole = lambda v: None if v is None or v != v else int(v)
        for pdf in parts:
            for x in pdf.itertuples(index=False):
                payload = x.html.encode("utf-8", "surrogatepass") if isinstance(x.html, str) else b""
                name = record_id(whole(x.page_id), x.number)
                data = record(name, x.url if isinstance(x.url, str) else None, payload, x.digest, record_id(whole(x.first), whole(x.first_number)) if x.revisit else None)
                records.append((name, data))
                size += len(data)
                if size >= limit:
                    yield closed(records)
                    records, size = [], 0
        if records:
            yield closed(records)

    return run


def write_archives(pages: DataFrame, least: int = LEAST, bundle: int = BUNDLE, frame: int = FRAME) -> DataFrame:
    """Archive ``pages(page_id, url, html)``: ``(bundle_id, data, index)``, written to the shared store and read lazily.

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest
    page id are responses, all others revisit it; null ids are never the smallest,
    and revisit only where there is one. Null html is empty, null urls
    have no target header. A record larger than a frame or bundle has its own. Rows that repeat have a record each,
    told apart by the row's number; ``pages`` should give its rows in the same order again, as tables do.
    """
    bounded_batches(pages.sparkSession)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("number"), F.sha2(html, 256).alias("digest"), (F.octet_length(html) >= least).alias("long"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number"))).alias("first")
    # written, so that the join can split the rows of one payload
    first = saved(rows.where("long").groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.number").alias("first_number")), "repeated")
    rows = rows.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("long") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)))
    rows = rows.select("page_id", "number", "url", "html", "digest", "first", "first_number", "revisit")
    return saved(rows.mapInPandas(_bundles(bundle, frame), f"bundle_id string, data binary, index {INDEX}"), "warc")


def record_index(bundles: DataFrame) -> DataFrame:
    """``(record_id, bundle_id, frame, offset, length)`` of all records: where each is found, payloads unread."""
    return bundles.select("bundle_id", F.explode("index").alias("e")).select("e.record_id", "bundle_id", "e.frame", "e.offset", "e.length")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(record_id, data)`` of the records that ``wanted(record_id)`` names: of each bundle only their frames are decompressed."""
    at = record_index(bundles).join(wanted.select("record_id").distinct(), "record_id")
    at = at.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("entries"))

    def run(parts):
        for pdf in parts:
            for data, entries in zip(pdf["data"], pdf["entries"]):
                yield pd.DataFrame([(e["record_id"], seek(data, e)) for e in entries], columns=["record_id", "data"])

    return bundles.select("bundle_id", "data").join(at, "bundle_id").select("data", "entries").mapInPandas(run, "record_id string, data binary")


def read_archives(bundles: DataFrame) -> DataFrame:
    """``(bundle_id, record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of all records.

    Each frame is decompressed once, records are cut by the index, and a response's length and digest are those of the payload read back.
    """

    def run(parts):
        unpack = zstandard.ZstdDecompressor()
        for pdf in parts:
            for name, data, index in zip(pdf["bundle_id"], pdf["data"], pdf["index"]):
                at = frames(data)
                rows, now, raw = [], -1, b""
                for e in sorted(index, key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != now:
                        now = e["frame"]
                        start, packed, size = at[now]
                        raw = unpack.decompress(data[start : start + packed], max_output_size=size)
                    h, body = parse(raw[e["offset"] : e["offset"] + e["length"]])
                    if h["WARC-Record-ID"] != e["record_id"]:
                        raise ValueError("the index names another record")
                    page = lambda name: None if (x := name.split(":")[2]) == "null" else int(x)
                    revisit = h["WARC-Type"] == "revisit"
                    body = body.partition(b"\r\n\r\n")[2]  # after the HTTP message's own headers
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                    rows.append((name, e["record_id"], page(e["record_id"]), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]) if revisit else len(body), digest, h["WARC-Type"], page(h["WARC-Refers-To"]) if revisit else None, None if revisit else body))
                out = pd.DataFrame(rows, columns=["bundle_id", "record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return bundles.mapInPandas(run, "bundle_id string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
