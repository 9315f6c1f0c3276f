"""Legacy archive conversion: ARC (versions 1 and 2) to WARC.

ARC records are found by their header lines and declared lengths; WARC records get synthesised identifiers,
timestamps, types and digests. Of records with equal payloads one stays a response, the others become revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import write_file
from .shared import kept, scratch

# Field names of the two ARC header versions, and the revisit profile of the WARC standard.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20  # of compressed records in a file; a longer record has a file of its own
KEY_HEADER = "X-Record-Key"  # carries the caller's integer key through both formats
_OPENING = re.compile(rb"(\d+) \d+[^\n]*\n")  # how the block of a version block begins
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the published namespace for URLs


def _member(content: bytes) -> bytes:
    """One gzip member, so that archives can be cut at records."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(content) + z.flush()


def _members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; an archive that is not compressed is one."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at, step = 0, 1 << 16
    while at < len(content):
        z, out, upto = zlib.decompressobj(31), [], at
        while not z.eof:
            if upto >= len(content):
                raise zlib.error("archive ends inside a member")
            out.append(z.decompress(content[upto : upto + step]))
            upto += step
        yield at, b"".join(out)
        at = min(upto, len(content)) - len(z.unused_data)


def arc_record(version: str, url: str, ip: str, date: str, mime: str, block: bytes, name: str) -> bytes:
    """A record: its version's header line and the declared length of ``block``."""
    if version == "1":
        line = f"{url} {ip} {date} {mime} {len(block)}"
    else:
        line = f"{url} {ip} {date} {mime} 200 - - 0 {name} {len(block)}"
    return line.encode() + b"\n" + block + b"\n"


def arc_header(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 converter\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, name)


def arc_entries(content: bytes) -> Iterator[dict | str]:
    """The records of one archive in order, version blocks left out: ``offset``, ``url``, ``ip``, ``date``, ``mime``,
    ``status``, ``block``; in the place of what cannot be read stands what is wrong with it. Records before any
    version block count as version 1.

    A version block is told by its content, not by its URL alone, as pages can have such URLs too. Reading goes on
    behind a record of known length, else with the next gzip member."""
    version, members, start = "1", _members(content), 0
    while True:
        try:
            start, text = next(members, (start, None))
        except zlib.error as error:
            yield str(error)
            return
        if text is None:
            return
        at = 0
        while at < len(text):
            if text[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            stop = text.find(b"\n", at)
            fields = text[at : stop if stop >= 0 else len(text)].rstrip(b"\r").decode("utf-8", "replace").split(" ")
            if stop < 0 or len(fields) not in (5, 10) or not fields[-1].isdecimal():
                yield f"no ARC header line at {start}+{at}"
                break
            length = int(fields[-1])
            block = text[stop + 1 : stop + 1 + length]
            opening = _OPENING.match(block) if fields[0].startswith("filedesc://") else None
            if len(block) < length:
                yield f"record at {start}+{at} ends before its declared length"
                break
            if opening and opening[1].decode() in ARC_FIELDS:
                version = opening[1].decode()
            elif opening:
                yield f"unknown ARC version at {start}+{at}"
            elif len(fields) != len(ARC_FIELDS[version].split()):
                yield f"header line at {start}+{at} is not of version {version}"
            else:
                yield {
                    "offset": start + at,
                    "url": fields[0],
                    "ip": fields[1],
                    "date": fields[2],
                    "mime": fields[3],
                    "status": fields[4] if version == "2" else None,
                    "block": block,
                }
            at = stop + 1 + length


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of :func:`arc_entries`; what cannot be read raises ValueError with the offset."""
    for entry in arc_entries(content):
        if isinstance(entry, str):
            raise ValueError(entry)
        yield entry


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a block without a head is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def head_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(date: str) -> str:
    """A 14-digit (or shorter) ARC date as a WARC timestamp; missing parts are their least values."""
    d = (date if date.isdigit() else "")[:14]
    d = d + "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(source: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source}#{offset}')}>"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for start, text in _members(content):
        at = 0
        while at < len(text):
            cut = text.find(b"\r\n\r\n", at)
            lines = text[at:cut].decode().split("\r\n")
            if cut < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {start}+{at}")
            fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
            length = int(fields["content-length"])
            yield fields, text[cut + 4 : cut + 4 + length]
            at = cut + 4 + length + 4


class _Files:
    """Collects records and cuts them into files of a task; yields the names of what it wrote."""

    def __init__(self, folder: str, suffix: str, opening):
        self.folder, self.suffix, self.opening = folder, suffix, opening
        self.part, self.count, self.held, self.size = TaskContext.get().partitionId(), 0, [], 0

    @property
    def name(self) -> str:
        return f"part-{self.part:06d}-{self.count:06d}{self.suffix}"

    def add(self, member: bytes) -> list[str]:
        done = self.flush() if self.held and self.size + len(member) > FILE_BYTES else []
        if not self.held:
            self.held.append(self.opening(self.name))
        self.held.append(member)
        self.size += len(member)
        return done

    def flush(self) -> list[str]:
        if not self.held:
            return []
        name = write_file(self.folder, self.name, b"".join(self.held))
        self.held, self.size, self.count = [], 0, self.count + 1
        return [name]


def _names(names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])


def _arc_writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = "12"[TaskContext.get().partitionId() % 2]
        out = _Files(folder, ".arc.gz", lambda name: _member(arc_header(version, name, date)))
        for batch in batches:
            for key, url, payload in zip(*[batch.column(c).to_pylist() for c in ("key", "url", "payload")], strict=True):
                body = (payload or "").encode()
                named = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{named}Content-Length: {len(body)}\r\n\r\n"
                target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "urn:unknown")
                block = head.encode() + body
                done = out.add(_member(arc_record(version, target, "0.0.0.0", date, "text/html", block, out.name)))
                if done:
                    yield _names(done)
        yield _names(out.flush())

    return run


def write_arcs(pages: DataFrame, folder: str, date: str = "20200101000000") -> DataFrame:
    """Writes (key, url, payload) rows as ARC files, both versions in turn by task; returns the file names."""
    return kept(pages.select("key", "url", "payload").mapInArrow(_arc_writer(folder, date), "file string"), "arcs")


RECORD = "file string, offset long, key long, digest string, size long, record binary, problem string"


def _arc_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("file", pa.string()), ("offset", pa.int64()), ("key", pa.int64()), ("digest", pa.string()),
         ("size", pa.int64()), ("record", pa.binary()), ("problem", pa.string())]
    )
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            file, rows, held = path.rsplit("/", 1)[-1], [], 0
            for r in arc_entries(content):
                if isinstance(r, str):
                    rows.append(dict.fromkeys(schema.names) | {"file": file, "problem": r})
                    continue
                head, payload = http_parts(r["block"])
                key = head_value(head, KEY_HEADER)
                lines = "\n".join([r["url"], r["ip"], r["date"], r["mime"]]).encode()
                packed = zlib.compress(lines + b"\n\n" + r["block"], 1)
                rows.append(
                    {"file": file, "offset": r["offset"], "key": None if key is None else int(key),
                     "digest": digest_of(payload), "size": len(payload), "record": packed, "problem": None}
                )
                held += len(packed)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record (``record`` is deflated), and one with ``problem`` for each part of an archive that cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(folder)
    return files.select("path", "content").mapInArrow(_arc_reader, RECORD)


def _warc_writer(folder: str):
    def opening(name: str) -> bytes:
        fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, 0), "WARC-Date": warc_date("")}
        fields |= {"WARC-Filename": name, "Content-Type": "application/warc-fields"}
        return _member(warc_record(fields, b"software: aprlens\r\nformat: WARC File Format 1.1\r\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(folder, ".warc.gz", opening)
        for batch in batches:
            for row in batch.to_pylist():
                lines, _, block = zlib.decompress(row["record"]).partition(b"\n\n")
                url, ip, date, mime = lines.decode().split("\n")
                head, payload = http_parts(block)
                first = (row["first_file"], row["first_offset"])
                revisit = first != (row["file"], row["offset"])
                fields = {
                    "WARC-Type": "revisit" if revisit else "response" if head else "resource",
                    "WARC-Record-ID": record_id(row["file"], row["offset"]),
                    "WARC-Date": warc_date(date),
                    "WARC-Target-URI": url,
                    "WARC-IP-Address": ip,
                    "WARC-Payload-Digest": f"sha1:{row['digest']}",
                    "Content-Type": "application/http; msgtype=response" if head else mime,
                }
                if revisit:
                    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*first)}
                    block = head
                fields["WARC-Block-Digest"] = f"sha1:{digest_of(block)}"
                done = out.add(_member(warc_record(fields, block)))
                if done:
                    yield _names(done)
        yield _names(out.flush())

    return run


def convert(spark: SparkSession, arcs: str, folder: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Converts the ARC files below ``arcs``; returns the names of the WARC files and the rows with problems.

    Among records with equal payloads of at least ``least`` bytes, the one with the largest key (a missing key is
    smallest; then the later record) is the response; shorter payloads are all responses.
    """
    records = read_arcs(spark, arcs)
    thin = kept(records.select("file", "offset", "key", "digest", "size", "problem"), "records")
    order = F.struct("key", "file", "offset")
    firsts = thin.where(F.col("problem").isNull() & (F.col("size") >= least)).groupBy("digest")
    firsts = firsts.agg(F.max(order).alias("first"))
    firsts = firsts.select(F.col("digest").alias("_digest"), "first.file", "first.offset")
    firsts = firsts.withColumnsRenamed({"file": "first_file", "offset": "first_offset"})
    whole = records.where("problem is null").join(firsts, F.col("digest") == F.col("_digest"), "left")
    own = F.col("size") < least
    whole = whole.select(
        "file",
        "offset",
        "digest",
        "record",
        F.when(own, F.col("file")).otherwise(F.col("first_file")).alias("first_file"),
        F.when(own, F.col("offset")).otherwise(F.col("first_offset")).alias("first_offset"),
    )
    ordered = whole.sortWithinPartitions("file", "offset")  # so that a repeated task writes the same files
    names = kept(ordered.mapInArrow(_warc_writer(folder), "file string"), "warcs")
    return names, thin.where("problem is not null").select("file", "problem")


WARC_ROW = "file string, id string, key long, digest string, size long, type string, refers string"


def _warc_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in WARC_ROW.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = []
            for fields, block in warc_records(content):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = http_parts(block)
                digest, size = digest_of(payload), len(payload)
                if kind == "revisit":  # it has the head of the full response only
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(head_value(head, "Content-Length") or 0)
                key = head_value(head, KEY_HEADER)
                key = None if key is None else int(key)
                file = path.rsplit("/", 1)[-1]
                rows.append((file, fields["warc-record-id"], key, digest, size, kind, fields.get("warc-refers-to")))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record but the warcinfo ones; ``digest`` and ``size`` are those of the full payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    return files.select("path", "content").mapInArrow(_warc_reader, WARC_ROW)


def archived(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``, one row per row of ``pages`` (page_id, url, html).

    A null html is an empty payload; empty payloads equal one another. A null page_id is the smallest and stays null;
    a null url gets a placeholder, blanks in one are escaped. Of repeated rows one is the response. Other columns are
    ignored; an empty table gives an empty result. A record that cannot be read back fails the job.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "archives")
    rows = pages.select(F.col("page_id").cast("long").alias("key"), "url", F.col("html").alias("payload"))
    empty = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if write_arcs(rows, f"{folder}/arc").isEmpty():
        return spark.createDataFrame([], empty)
    names, problems = convert(spark, f"{folder}/arc", f"{folder}/warc", least)
    lost = problems.limit(5).collect()
    if lost:
        raise RuntimeError(f"records lost in conversion: {'; '.join(f'{r["file"]}: {r["problem"]}' for r in lost)}")
    found = read_warcs(spark, f"{folder}/warc").join(names.distinct(), "file", "left_semi")
    found = kept(found, "found")
    targets = found.where("type <> 'revisit'").select(F.col("id").alias("_id"), F.col("key").alias("refers_to"))
    out = found.join(targets, (F.col("refers") == F.col("_id")), "left")
    return out.select(
        F.col("key").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
