"""WARC records in ZIP-packaged archives, read by byte ranges.

An archive is a ZIP whose members are stored as they are:
``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (one line per record, sorted by url key and time, with
its offset and length). The reader parses the end of the archive, its central directory (ZIP64 where
present) and the index, then fetches single records. Nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.llm._stage import file_store, folder, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below this size are never deduplicated.
LEAST_SHARED = 100
#: An archive is closed by the record that brings it to this size; its index fits a task's memory.
ARCHIVE_BYTES = 64 << 20
#: Bytes fetched at a time where many records lie next to each other.
READ_AHEAD = 4 << 20
LEVEL = 4
STAMP, KEY_STAMP = "2024-01-01T00:00:00Z", "20240101000000"

# Signatures and sizes of the ZIP format; fixed values.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """A stored member: its name, the place of its local header and its size."""

    name: str
    header: int
    size: int


class Archive:
    """ZIP directory of an open random-access file; reads ranges of stored members."""

    def __init__(self, file):
        self.file = file
        self.size = file.size()
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _range(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"archive ends within the range {start}+{length}")
        return data

    def _directory(self) -> Iterator[Member]:
        length = min(self.size, 22 + 0xFFFF + 20)
        tail = self._range(self.size - length, length)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP archive: no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (size, start):
            if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
                raise ValueError("ZIP64 locator is missing")
            where = struct.unpack_from("<Q", tail, at - 12)[0]
            record = self._range(where, 56)
            if record[:4] != END64:
                raise ValueError("ZIP64 end of central directory is missing")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
        yield from self._entries(self._range(start, size), count)

    def _entries(self, directory: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != ENTRY:
                raise ValueError("central directory is damaged")
            method, = struct.unpack_from("<H", directory, at + 10)
            packed, full = struct.unpack_from("<II", directory, at + 20)
            names, extras, comments = struct.unpack_from("<HHH", directory, at + 28)
            header, = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + names].decode()
            extra, end = at + 46 + names, at + 46 + names + extras
            while extra + 4 <= end:
                kind, length = struct.unpack_from("<HH", directory, extra)
                if kind == 1:  # ZIP64: only the fields that are full, in this order
                    field = extra + 4
                    if full == FULL32:
                        full, field = struct.unpack_from("<Q", directory, field)[0], field + 8
                    if packed == FULL32:
                        packed, field = struct.unpack_from("<Q", directory, field)[0], field + 8
                    if header == FULL32:
                        header = struct.unpack_from("<Q", directory, field)[0]
                extra += 4 + length
            if method == 0:  # deflated members cannot be read by range
                yield Member(name, header, full)
            at = end + comments

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member; the whole member by default."""
        member = self.members[name]
        if name not in self._starts:
            local = self._range(member.header, 30)
            if local[:4] != LOCAL:
                raise ValueError("local header is missing")
            names, extras = struct.unpack_from("<HH", local, 26)
            self._starts[name] = member.header + 30 + names + extras
        length = member.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > member.size:
            raise ValueError(f"range {offset}+{length} lies outside {name}")
        return self._range(self._starts[name] + offset, length)


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields with lower-case names, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("record is cut")
    return fields, rest[:length]


def target_uri(url: str) -> str:
    """The url with what a header or a URI may not hold percent-encoded; percent signs stay."""
    return quote(url, safe="%!#$&'()*+,/:;=?@[]~")


def url_key(url: str) -> str:
    """Sort key of an index line: host labels from the right, then path and query, lower-case."""
    rest = target_uri(url).partition("://")[2] or target_uri(url)
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.split('.')))}){slash}{path}".lower()


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """Record of a page; the one response of a shared payload has the id that follows from its digest."""
    shared = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'payload:{digest}')}>"
    response = refers_to is None
    own = response and page_id is not None and len(payload) >= LEAST_SHARED
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", shared if own else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", STAMP), ("WARC-Target-URI", target_uri(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload))),
    ]
    if target_uri(url) != url:  # as it was given
        fields.append(("Page-Url", base64.urlsafe_b64encode(url.encode()).decode()))
    if not response:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", shared), ("Refers-To-Page", str(refers_to)),
        ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if response else b"")
    return record_bytes(fields, block)


def _write(batches: Iterator[pa.RecordBatch], base: str, most: int) -> Iterator[pa.RecordBatch]:
    """Archives of a task's pages; yields (path, records) of each, known only when the task succeeds.

    Names are new in every attempt: what a lost attempt leaves is never listed.
    """
    store, root = file_store(base)
    store.create_dir(root, recursive=True)
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))))
    row = next(rows, None)
    while row is not None:
        name = f"{uuid.uuid4().hex}.wacz"
        at, index = 0, []
        with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            with archive.open(DATA, "w", force_zip64=True) as data:
                while row is not None and at < most:
                    page_id, url, html, digest, refers_to = row
                    packed = gzip.compress(_record(page_id, url, html.encode(), digest, refers_to), LEVEL, mtime=0)
                    data.write(packed)
                    entry = {"url": target_uri(url), "filename": DATA, "offset": at, "length": len(packed)}
                    index.append(f"{url_key(url)} {KEY_STAMP} {json.dumps(entry)}")
                    at += len(packed)
                    row = next(rows, None)
            archive.writestr(INDEX, "\n".join(sorted(index)))
        yield pa.RecordBatch.from_pydict({"path": [f"{base.rstrip('/')}/{name}"], "records": pa.array([len(index)], pa.int64())})


def write_archives(pages: DataFrame, base: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) below ``base``; returns their list (path, records), staged.

    Of the records with equal payloads of LEAST_SHARED bytes or more, that
    with the smallest page_id (then url, one of equal rows) is a response,
    the others revisit it; if none has a page_id all are responses. Only
    rows that are equal throughout are shuffled with their html.
    """
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    prints = stage(keyed.where(F.octet_length("html") >= LEAST_SHARED).groupBy("page_id", "url", "digest").agg(F.count("*").alias("n")), "payloads")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = stage(
        prints.groupBy("digest").agg(F.min(named).alias("head"), F.sum("n").alias("total"))
        .where("total > 1 and head is not null").select("digest", "head"),
        "payloads",
    )
    is_head = F.col("page_id").eqNullSafe(F.col("head.page_id")) & (F.col("url") == F.col("head.url"))
    placed = prints.join(first, "digest").select(
        F.col("page_id").alias("of"), F.col("url").alias("at"), F.col("digest").alias("print"), "n",
        F.col("head.page_id").alias("refers_to"), is_head.alias("is_head"),
    )
    again = stage(placed.where("not is_head").drop("n", "is_head"), "payloads")
    twins = stage(placed.where("is_head and n > 1").drop("is_head"), "payloads")
    same = keyed["page_id"].eqNullSafe(F.col("of")) & (keyed["url"] == F.col("at")) & (keyed["digest"] == F.col("print"))
    columns = ["page_id", "url", "html", "digest"]
    out = keyed.withColumn("refers_to", F.lit(None).cast("long"))
    if not again.isEmpty():
        out = keyed.join(broadcast_if_small(again), same, "left").select(*columns, "refers_to")
    if not twins.isEmpty():
        held = broadcast_if_small(twins)
        one = keyed.join(held, same).dropDuplicates(["page_id", "url", "digest"])
        copies = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        revisit = F.when(F.col("copy") > 1, F.col("refers_to"))
        rest = out.join(held.select("of", "at", "print"), same, "left_anti")
        out = rest.unionByName(copies.select(*columns, revisit.alias("refers_to")))
    return stage(out.mapInArrow(lambda it: _write(it, base, most), "path string, records long"), "archives")


def _entries(archive: Archive) -> list[str]:
    return [line for line in archive.read(INDEX).decode().split("\n") if line]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, place = file_store(path)
            with store.open_input_file(place) as file:
                archive = Archive(file)
                entries = sorted((json.loads(line.split(" ", 2)[2]) for line in _entries(archive)), key=lambda e: e["offset"])
                while entries:
                    low, n = entries[0]["offset"], 1
                    while n < len(entries) and entries[n]["offset"] + entries[n]["length"] - low <= READ_AHEAD:
                        n += 1
                    run, entries = entries[:n], entries[n:]
                    data = archive.read(DATA, low, run[-1]["offset"] + run[-1]["length"] - low)
                    yield _rows([data[e["offset"] - low : e["offset"] - low + e["length"]] for e in run])


def _rows(records: list[bytes]) -> pa.RecordBatch:
    out: dict[str, list] = {c: [] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    for packed in records:
        fields, block = parse_record(zlib.decompress(packed, wbits=31))
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        length = int(fields["payload-length"])
        if payload is not None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of page {fields['page-id']} does not match its digest")
        out["page_id"].append(int(fields["page-id"]) if fields["page-id"] else None)
        given = fields.get("page-url")
        out["url"].append(fields["warc-target-uri"] if given is None else base64.urlsafe_b64decode(given).decode())
        out["payload"].append(payload)
        out["payload_bytes"].append(length)
        out["payload_digest"].append(digest)
        out["record_type"].append(kind)
        out["refers_to"].append(int(fields["refers-to-page"]) if "refers-to-page" in fields else None)
    types = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in out.items()], list(out))


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records of the archives listed in ``paths`` (path): SCHEMA; a revisit's payload is null.

    Payloads are checked against their digests; damaged archives, indexes
    and records raise. Members that are not stored are left out of the
    directory, so an archive without a stored index raises.
    """
    listed = paths.select("path")
    return listed.repartition(tasks or max(1, min(listed.count(), 10_000)), "path").mapInArrow(_read, SCHEMA)


def _fetch(batches: Iterator[pa.RecordBatch], urls: list[str]) -> Iterator[pa.RecordBatch]:
    """Records of some urls: their lines are found in the sorted index, and only their ranges are read."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, place = file_store(path)
            with store.open_input_file(place) as file:
                archive = Archive(file)
                lines = _entries(archive)
                found = []
                for url in urls:
                    key = f"{url_key(url)} "
                    at = bisect_left(lines, key)
                    while at < len(lines) and lines[at].startswith(key):
                        entry = json.loads(lines[at].split(" ", 2)[2])
                        if entry["url"] == target_uri(url):
                            found.append(archive.read(DATA, entry["offset"], entry["length"]))
                        at += 1
                if found:
                    yield _rows(found)


def fetch(paths: DataFrame, urls: list[str]) -> DataFrame:
    """Records (SCHEMA) of a few urls in the archives listed in ``paths`` (path), read by range."""
    wanted = sorted(set(urls))
    return paths.select("path").mapInArrow(lambda it: _fetch(it, wanted), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url. A null html is an empty payload, a null url an empty
    one. Of pages with equal long payloads one is a response, also where
    page_id repeats or is null; where none has a page_id all are. Columns other than page_id, url and html are not read. An empty table
    gives no rows.
    """
    listed = write_archives(pages, folder(pages.sparkSession, "archives"))
    return read_archives(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to,
       coalesce(url, '') AS url
FROM (SELECT *, octet_length(encode(coalesce(html, ''))) >= 100 AND first_id IS NOT NULL AND place > 1 AS again
  FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id,
      row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, coalesce(url, '')) AS place FROM pages))
"""
