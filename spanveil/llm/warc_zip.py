"""Web archives in ZIP packages: written by tasks, read by ranges of bytes without unpacking.

A package holds, stored as they are, ``archive/data.warc.gz`` (a gzip member
for each record), ``indexes/index.cdxj`` (a line for each record, with its
place) and ``datapackage.json``. A reader takes the end of a package for its
directory, the index member for the places of records, and then only the
ranges of the records themselves.

Files are reached through ``pyarrow.fs``, from the tasks; what is passed
through Spark are paths, places and results.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.plans.tables import stored

ARCHIVE_BYTES = 256 << 20  # a package closes when its records take so many bytes
ARCHIVE_RECORDS = 500_000  # or when there are so many
LEAST_PAYLOAD = 100  # shorter payloads are always written
WINDOW = 8 << 20  # bytes of one read; a longer record is read at once
HOT = 100_000  # records of one payload that a join brings together at most
SENT = 200_000  # payloads with copies that are broadcast, 56 bytes each
DATE = "1970-01-01T00:00:00Z"
PREFIX = "urn:record:"

PACKAGES = "path string, n_bytes long, n_records long"
PLACES = "path string, start long, length long"
RECORDS = "id string, url string, record_type string, refers_id string, n_bytes long, digest string"


# ------------------------------------------------------------------ files


def file_at(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Ranges:
    """A file that is read by ranges."""

    def __init__(self, path: str):
        system, at = file_at(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"{length} bytes expected at {start}, {len(data)} found")
        return data

    def close(self) -> None:
        self.file.close()


# ------------------------------------------------------------- directories


def _end_of_directory(f) -> tuple[int, int, int]:
    """(start, bytes, entries) of the central directory, by the ZIP64 record where there is one."""
    tail_at = max(0, f.size - 22 - 0xFFFF)
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at + 3)
    if at < 0:
        raise ValueError("not a ZIP package: no end of directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at  # where the directory ends, if nothing follows it
    if end >= 20 and (locator := f.read(end - 20, 20))[:4] == b"PK\x06\x07":
        spot = struct.unpack_from("<Q", locator, 8)[0]
        found = None
        # bytes in front of the package move the record; it then stands just before the locator
        for s in (spot, end - 20 - 56):
            if 0 <= s <= end - 76 and (record := f.read(s, 56))[:4] == b"PK\x06\x06":
                found = s
                break
        if found is None:
            raise ValueError("not a ZIP package: no ZIP64 record where its locator points")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
        end = found
    return end - length, length, entries, end - length - start


def members(f, piece: int = 1 << 20) -> Iterator[dict]:
    """The entries of the central directory, read piece by piece.

    ``skipped`` is how many bytes stand in front of the package; the places
    in it count from behind them.
    """
    start, length, entries, skipped = _end_of_directory(f)
    if start < 0:
        raise ValueError("not a ZIP package: the directory is longer than the file")
    held, at, stop = b"", start, start + length
    for _ in range(entries):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if at >= stop:
                raise ValueError("the central directory ends early")
            held += f.read(at, min(piece, stop - at))
            at = min(at + piece, stop)
        if held[:4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, size, n, m, k = struct.unpack_from("<IIHHH", held, 20)
        header = struct.unpack_from("<I", held, 42)[0]
        name, extra = held[46 : 46 + n], held[46 + n : 46 + n + m]
        held = held[46 + n + m + k :]
        wide = b""
        while len(extra) >= 4:
            kind, count = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = extra[4 : 4 + count]
            extra = extra[4 + count :]
        if (need := 8 * ((size == 0xFFFFFFFF) + (packed == 0xFFFFFFFF) + (header == 0xFFFFFFFF))) > len(wide):
            raise ValueError(f"entry {name!r} lacks {need} bytes of ZIP64 sizes")
        if size == 0xFFFFFFFF:
            size, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if packed == 0xFFFFFFFF:
            packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if header == 0xFFFFFFFF:
            header = struct.unpack_from("<Q", wide)[0]
        yield {
            "name": name.decode("utf-8" if flags & 0x800 else "cp437"), "stored": method == 0 and not flags & 1,
            "bytes": packed, "header": header + skipped,
        }


def data_start(f, member: dict) -> int:
    """Where the bytes of a member begin; its local header has its own lengths."""
    local = f.read(member["header"], 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member['name']}")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", local, 26))


def _lines(f, start: int, length: int, zipped: bool) -> Iterator[bytes]:
    """The lines of a stored index, read by windows."""
    rest, unzip = b"", zlib.decompressobj(31) if zipped else None
    for at in range(start, start + length, WINDOW):
        data = f.read(at, min(WINDOW, start + length - at))
        if unzip:
            out = []
            while data:  # an index may have several gzip members
                out.append(unzip.decompress(data))
                data = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
            data = b"".join(out)
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def places(f) -> Iterator[tuple[int, int]]:
    """(start in the package, bytes) of every record that the indexes of a package name."""
    found = list(m for m in members(f) if m["name"].startswith(("archive/", "indexes/")) and not m["name"].endswith("/"))
    starts = {}
    for m in found:
        if not m["stored"]:
            raise ValueError(f"member {m['name']} is not stored as it is; its records have no ranges")
        starts[m["name"]] = data_start(f, m)
    indexes = [m for m in found if m["name"].startswith("indexes/") and m["name"].rsplit(".", 1)[-1] in ("cdxj", "cdx", "gz")]
    if not indexes:
        raise ValueError("the package has no index")
    for m in indexes:
        for line in _lines(f, starts[m["name"]], m["bytes"], m["name"].endswith(".gz")):
            if b"{" in line:
                entry = json.loads(line[line.index(b"{") :])
                yield starts["archive/" + entry["filename"]] + int(entry["offset"]), int(entry["length"])


# ----------------------------------------------------------------- records


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record as a gzip member; headers without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    whole = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(whole, 6, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record ends early")
    return headers, rest[:n]


def _uri(name: str | None) -> str:
    return f"<{PREFIX}{quote(name or '', safe='')}>"


def _id_in(uri: str | None) -> str | None:
    return None if uri is None else unquote(uri.strip("<>").removeprefix(PREFIX)) or None


def _page_record(id_: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http = (http + f"Content-Length: {len(payload)}\r\n\r\n").encode()
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": _uri(id_),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": None if first is None else _uri(first),
        "WARC-Profile": None if first is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "Content-Type": "application/http; msgtype=response",
    }
    return record_bytes(headers, http + payload if first is None else http)


# ----------------------------------------------------------------- writing


class _Package:
    """One package being written, front to back."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}"
        system, at = file_at(self.path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(self._info("archive/data.warc.gz"), "w", force_zip64=True)
        self.index, self.at, self.sum = [], 0, hashlib.sha256()
        self.put(record_bytes({"WARC-Type": "warcinfo", "WARC-Date": DATE, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"}, b"format: WARC/1.1\r\n"))

    def _info(self, name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def put(self, data: bytes, entry: dict | None = None) -> None:
        if entry is not None:
            self.index.append((entry, self.at, len(data)))
        self.data.write(data)
        self.sum.update(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        lines = []
        for entry, at, n in self.index:
            whole = entry | {"length": n, "offset": at, "filename": "data.warc.gz"}
            lines.append(f"{quote(entry['url'] or '-', safe='%/:=&?')} 19700101000000 {json.dumps(whole)}\n")
        cdxj = "".join(sorted(lines)).encode()
        self.zip.writestr(self._info("indexes/index.cdxj"), cdxj)
        parts = [("archive/data.warc.gz", self.at, self.sum.hexdigest()), ("indexes/index.cdxj", len(cdxj), hashlib.sha256(cdxj).hexdigest())]
        resources = [{"path": p, "bytes": n, "hash": f"sha256:{h}"} for p, n, h in parts]
        self.zip.writestr(self._info("datapackage.json"), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, len(self.index)


def _writer(folder: str, most_bytes: int, most_records: int):
    def run(batches):
        # attempts have names of their own: what a lost attempt leaves is in no list of packages
        part, made, open_ = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], None

        def listed():
            names = [x.split(" ")[0] for x in PACKAGES.split(", ")]
            types = (pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "first")]
            for k in range(batch.num_rows):
                id_, url, payload, digest, first = (c[k].as_py() for c in columns)
                open_ = open_ or _Package(folder, f"part-{part}-{len(made):05d}.wacz")
                kind = "response" if first is None else "revisit"
                open_.put(_page_record(id_, url, payload, digest, first), {"url": url, "digest": f"sha256:{digest}", "type": kind})
                if open_.at >= most_bytes or len(open_.index) >= most_records:
                    made.append(open_.close())
                    open_ = None
        if open_:
            made.append(open_.close())
        if made:
            yield listed()

    return run


def _with_first(rows: DataFrame) -> DataFrame:
    """Rows with ``first``, the smallest id of their payload, where they are to refer to it."""
    long = rows.where(F.octet_length("payload") >= LEAST_PAYLOAD)
    groups = long.groupBy(F.unhex("digest").alias("key")).agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n"))
    copies = stored(groups.where("n > 1 AND least IS NOT NULL"), "equal-payloads")
    size = copies.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most")).first()
    # short payloads have keys that no group has, each its own
    key = F.when(F.octet_length("payload") >= LEAST_PAYLOAD, F.unhex("digest")).otherwise(F.xxhash64("own", "url").cast("string").cast("binary"))
    if size["rows"] <= SENT:
        joined = rows.withColumn("key_", key).join(F.broadcast(copies), F.col("key_") == F.col("key"), "left")
    else:
        # a payload of many pages is dealt over as many parts as it needs; rows without a copy by their own digest
        salts = max(1, -(-int(size["most"]) // HOT))
        salted = rows.withColumn("key_", key).withColumn("salt_", F.pmod(F.xxhash64("own", "url"), F.lit(salts)).cast("int"))
        dealt = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(dealt, (F.col("key_") == F.col("key")) & (F.col("salt_") == F.col("salt")), "left")
    refers = F.col("least").isNotNull() & (F.col("own").isNull() | (F.col("own") > F.col("least")))
    return joined.withColumn("first", F.when(refers, F.col("least").cast("string")))


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS,
) -> DataFrame:
    """Write a record for each page into packages under ``folder``; gives the list of packages ``path, n_bytes, n_records``.

    Of pages with equal payloads of ``LEAST_PAYLOAD`` bytes or more, the one
    with the smallest id has the payload (``response``); the others refer to
    it (``revisit``). Each task writes its pages as they come, so nothing is
    shuffled but the digests; where over 200,000 payloads occur more than
    once, pages meet them in a join instead of a broadcast.

    The list is stored and is what makes packages count: a task that was lost
    and repeated leaves files that are in no list. NULL payloads are empty.
    NULL ids stand before no other id: such pages refer to the page with the
    smallest id, and among themselves all keep their payloads. Rows that
    repeat the smallest id keep their payloads as well. A NULL url has no
    header. An empty table makes no package and an empty list.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("own"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = _with_first(rows.withColumn("digest", F.sha2("payload", 256)))
    rows = rows.select(F.col("own").cast("string").alias("id"), "url", "payload", "digest", "first")
    return stored(rows.mapInArrow(_writer(folder, most_bytes, most_records), PACKAGES), "packages")


# ----------------------------------------------------------------- reading


def _batches(rows: Iterator[tuple], schema: str, size: int = 8192) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    held = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=list(names))

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def _index_reader(batches):
    def rows():
        for batch in batches:
            for path in batch.column("path").to_pylist():
                f = Ranges(path)
                try:
                    for start, length in places(f):
                        yield path, start, length
                finally:
                    f.close()

    yield from _batches(rows(), PLACES)


def _runs(batches) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Ranges of one file that follow each other, up to a window."""
    path, run = None, []
    for batch in batches:
        for p, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
            if run and (p != path or start != run[-1][0] + run[-1][1] or start + length - run[0][0] > WINDOW):
                yield path, run
                run = []
            path = p
            run.append((start, length))
    if run:
        yield path, run


def _record_reader(payloads: bool):
    schema = RECORDS + (", payload binary" if payloads else "")

    def rows(batches):
        f, path = None, None
        for p, run in _runs(batches):
            if p != path:
                if f:
                    f.close()
                f, path = Ranges(p), p
            data, base = f.read(run[0][0], run[-1][0] + run[-1][1] - run[0][0]), run[0][0]
            for start, length in run:
                headers, block = parse_record(gzip.decompress(data[start - base : start - base + length]))
                kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha256:")
                if kind == "response":
                    block = block.partition(b"\r\n\r\n")[2] if headers["content-type"].startswith("application/http") else block
                    own = hashlib.sha256(block).hexdigest()
                    if digest and own != digest:
                        raise ValueError(f"record {headers['warc-record-id']} of {p} is damaged")
                    size, digest = len(block), own
                elif kind == "revisit":
                    size, block = None, None
                else:
                    continue
                url = headers.get("warc-target-uri")
                row = (_id_in(headers["warc-record-id"]), url, kind, _id_in(headers.get("warc-refers-to")), size, digest)
                yield row + ((block,) if payloads else ())
        if f:
            f.close()

    def run(batches):
        yield from _batches(rows(batches), schema, 64 if payloads else 8192)

    return run, schema


def read_records(packages: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records of listed packages: ``id, url, record_type, refers_id, n_bytes, digest`` (and ``payload``).

    Directories and indexes are read first. The places of records are then
    dealt out by package and window of 64 MB, so that one large package is
    read by many tasks, and each task reads neighbours together. A payload
    that doesn't have its digest is an error. Of a ``revisit``, the sizes are
    those of the record it refers to (see :func:`resolve`); here they are NULL.
    """
    spots = packages.select("path").mapInArrow(_index_reader, PLACES)
    dealt = spots.repartition("path", F.floor(F.col("start") / F.lit(64 << 20))).sortWithinPartitions("path", "start")
    run, schema = _record_reader(payloads)
    return dealt.mapInArrow(run, schema)


def _salt(id_: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(salts)).cast("int")


def resolve(records: DataFrame) -> DataFrame:
    """Stored records, those of type ``revisit`` with the size of the payload they refer to.

    One payload may have a third of all records: its revisits are dealt over
    parts, as many as the number of revisits asks for, and only parts in use
    get the response. A revisit whose response is missing is an error.
    """
    revisits = records.where("record_type = 'revisit'")
    salts = max(1, -(-revisits.count() // HOT))
    salted = revisits.drop("n_bytes").withColumn("salt", _salt(F.col("id"), salts))
    wanted = salted.select(F.col("refers_id").alias("key_id"), F.col("digest").alias("key"), "salt").distinct()
    full = records.where("record_type = 'response'").groupBy("id", "digest").agg(F.first("n_bytes").alias("n_bytes"))
    full = full.withColumnsRenamed({"id": "full_id", "digest": "full_digest"})
    parts = wanted.join(full, (F.col("key_id") == F.col("full_id")) & (F.col("key") == F.col("full_digest")), "left")
    parts = parts.select("key_id", "key", F.col("salt").alias("key_salt"), "n_bytes")
    on = (F.col("refers_id") == F.col("key_id")) & (F.col("digest") == F.col("key")) & (F.col("salt") == F.col("key_salt"))
    found = salted.join(parts, on, "left").withColumn(
        "n_bytes", F.coalesce("n_bytes", F.raise_error(F.concat(F.lit("no response for record "), F.coalesce("id", F.lit("NULL")))).cast("long"))
    )
    return records.where("record_type <> 'revisit'").unionByName(found.select(*records.columns))


def page_report(packages: DataFrame) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to`` of every record, read back from the packages."""
    records = resolve(stored(read_records(packages), "records"))
    return records.select(
        "id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_id").alias("refers_to")
    )
