"""WARC archives with a two-level capture index.

Archives: every page is a record, a gzip member of its own, in a file of `ARCHIVE_BYTES` or less (one larger record has a file of
its own).  A record is a response with the page's HTML as payload, or, where a page of larger page_id has an equal payload of
`least` bytes or more, a revisit that names that page's record and keeps the headers alone.

Index: captures are sorted by (key, archive, place); a key is the URL with its host reversed, `org,example,www)/path?query`.
Each range of captures is an index file of blocks, `LINES` lines of text each, compressed on their own.  Beside it stands its
directory: the first key of each block and where the block lies.  `parts` has a row for each index file: its first and last key.

    archives/<name>.warc.gz     index/<name>.cdx.gz, index/<name>.directory     captures/, parts/ (Parquet)

Looking up: a key goes to the index files whose keys span it, is searched for by halving in their directories, and the blocks
found are read by their ranges.  The captures then are read in the order of archives and places, also by ranges.  Reading
recomputes length and SHA-1 of every payload and raises an error where a record differs from what it says.

Files get new names in every attempt of a task and count once the rows that name them are written, so a lost executor leaves
files that nobody reads, never half an archive.

Null html is an empty payload; empty payloads are equal to each other like others.  Null url has the key `)`.  A null page_id is
smaller than all others; where all pages of a payload have none, all are responses.  Of repeated rows of the largest
page_id of a payload all are responses.  A payload is held whole, of any length.  An empty table gives no archives and no
rows.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import new_path, slices, spread_join

ARCHIVE_BYTES, LINES, PART_CAPTURES, GAP = 1 << 30, 1_024, 1_000_000, 1 << 20
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", re.DOTALL)
_CAPTURE = "key string, archive string, place long, length long"


def surt(url: str | None) -> str:
    """The URL with its host reversed: scheme, user, default ports and what follows # go, host letters are lowered."""
    found = _URL.match(url or "")
    if not found:
        return ")" + _plain((url or "").split("#")[0])
    host, port, path = found.group(1).lower(), found.group(2), found.group(3) or "/"
    name = host if host.startswith("[") else ",".join(reversed(host.rstrip(".").split(".")))
    return f"{name}{':' + port if port and port not in ('80', '443') else ''}){_plain(path if path.startswith('/') else '/' + path)}"


def _plain(x: str) -> str:
    """Without the signs that would break a line of the index."""
    return "".join(f"%{ord(c):02X}" if c <= " " else c for c in x)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; refers_to: the page whose response has the payload."""

    def name(page: int | None) -> str:
        return f"<urn:page:{'-' if page is None else page}:{digest}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, body = ("response", http + payload) if refers_to is None else ("revisit", http)
    own = name(page_id) if refers_to is None else f"{name(page_id)[:-1]}:revisit>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {_plain(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is None:
        lines += [f"WARC-Block-Digest: sha1:{payload_digest(body)}"]
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of a record that has been checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/") or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError("a record does not have the length that it states")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http).group(1))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was stored")

    def page(name: str | None) -> int | None:
        said = (name or "urn:page:-").split(":")[2]
        return None if said == "-" else int(said)

    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses) of every page."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = source.withColumn("print", F.sha2("payload", 256))
    long = keyed.where(F.length("payload") >= least)
    repeated = long.groupBy("print").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select(F.col("print").alias("same"), "largest")
    met = spread_join(keyed, repeated, F.col("print"), "same", F.struct("page_id", "url"), "left")
    revisit = F.col("largest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")))
    return met.select("page_id", "url", "payload", F.when(revisit, F.col("largest")).alias("refers_to"))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _archived(roles: DataFrame, folder: str, archive_bytes: int) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        out, name, place = None, "", 0
        for batch in batches:
            for some in slices(batch, "payload", 8 << 20):
                rows: list[tuple] = []
                for page_id, url, payload, refers_to in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    data = gzip.compress(record(page_id, url, payload, payload_digest(payload), refers_to), 6, mtime=0)
                    if out is None or place + len(data) > archive_bytes:
                        if out is not None:
                            out.close()
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    rows.append((surt(url), name, place, len(data)))
                    place += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "archive", "place", "length"])
        if out is not None:
            out.close()

    return roles.mapInArrow(write, _CAPTURE)


def _indexed(captures: DataFrame, folder: str, lines: int) -> DataFrame:
    """Write the index files of sorted ranges of captures; name, first_key, last_key, n of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, place, first, last = uuid.uuid4().hex, 0, 0, None, ""
        directory: list[str] = []
        block: list[str] = []
        store, base = _opened(folder)
        out = None

        def close() -> None:
            nonlocal place
            data = gzip.compress("".join(block).encode(), 6, mtime=0)
            out.write(data)
            directory.append(f"{block[0].split(' ', 1)[0]} {place} {len(data)}\n")
            place += len(data)
            block.clear()

        for batch in batches:
            for key, archive, at, length in zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "place", "length")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out, first = store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None), key
                block.append(f"{key} {archive} {at} {length}\n")
                n, last = n + 1, key
                if len(block) == lines:
                    close()
        if out is not None:
            if block:
                close()
            out.close()
            with store.open_output_stream(f"{base}/{name}.directory", compression=None) as side:
                side.write("".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([last]), pa.array([n])], names=["name", "first_key", "last_key", "n"])

    return captures.mapInArrow(write, "name string, first_key string, last_key string, n long")


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, lines: int = LINES, part_captures: int = PART_CAPTURES) -> None:
    """Write archives and index of pages (page_id, url, html) below path."""
    spark = pages.sparkSession
    _archived(_roles(pages, least), f"{path}/archives", archive_bytes).write.parquet(f"{path}/captures")
    captures = spark.read.schema(_CAPTURE).parquet(f"{path}/captures")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // part_captures))
    order = ["key", "archive", "place"]
    _indexed(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order), f"{path}/index", lines).write.parquet(f"{path}/parts")


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """key, archive, place, length of all captures of the keys (a table with a column key; repeated ones count once).

    What is known of the index on the driver and in every task is two keys for each index file.
    """
    spark = keys.sparkSession
    found = spark.read.parquet(f"{path}/parts").orderBy("first_key", "last_key").collect()
    firsts, lasts, names = ([r[c] for r in found] for c in ("first_key", "last_key", "name"))
    # Spark and the index order text by its bytes, Python by code points, which is the same order
    shared = spark.sparkContext.broadcast((firsts, lasts, names))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = shared.value
        for batch in batches:
            rows = [(k, n) for k in batch.column("key").to_pylist() for n in names[bisect_left(lasts, k) : bisect_right(firsts, k)]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "name"])

    folder = f"{path}/index"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        name, tops, places, source = None, [], [], None
        at, lines = -1, []
        for batch in batches:
            rows: list[tuple] = []
            for key, part in zip(batch.column("key").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if part != name:
                    name, at = part, -1
                    with store.open_input_stream(f"{base}/{name}.directory", compression=None) as side:
                        listed = [x.split(" ") for x in side.read().decode().split("\n")[:-1]]
                    tops, places = [x[0] for x in listed], [(int(x[1]), int(x[2])) for x in listed]
                    source = store.open_input_file(f"{base}/{name}.cdx.gz")
                # captures of a key may begin in the block before the first one that begins with it
                for k in range(max(0, bisect_left(tops, key) - 1), bisect_right(tops, key)):
                    if k != at:
                        at, lines = k, [x.split(" ") for x in gzip.decompress(source.read_at(places[k][1], places[k][0])).decode().split("\n")[:-1]]
                    lo = bisect_left(lines, key, key=lambda x: x[0])
                    for line in lines[lo : bisect_right(lines, key, lo, key=lambda x: x[0])]:
                        rows.append((line[0], line[1], int(line[2]), int(line[3])))
                    if len(rows) > 50_000:
                        yield _captures(rows)
                        rows = []
            if rows:
                yield _captures(rows)

    routed = keys.select("key").distinct().mapInArrow(route, "key string, name string")
    return routed.repartition("name").sortWithinPartitions("name", "key").mapInArrow(search, _CAPTURE)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "archive", "place", "length"])


_READ = {"key": "string", "page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_captures(captures: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """key, page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload of captures.

    Captures are read in the order of archives and places; places less than GAP bytes apart are read at once.
    """
    folder, columns = f"{path}/archives", [c for c in _READ if payloads or c != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        name, source = None, None
        for batch in batches:
            keys, archives, places, lengths = (batch.column(c).to_pylist() for c in ("key", "archive", "place", "length"))
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and archives[hi] == archives[lo] and 0 <= places[hi] - places[hi - 1] - lengths[hi - 1] < GAP and places[hi] + lengths[hi] - places[lo] < 8 * GAP:
                    hi += 1
                if archives[lo] != name:
                    name, source = archives[lo], store.open_input_file(f"{base}/{archives[lo]}")
                data = source.read_at(places[hi - 1] + lengths[hi - 1] - places[lo], places[lo])
                rows = []
                for k in range(lo, hi):
                    at = places[k] - places[lo]
                    got = parsed(zlib.decompress(data[at : at + lengths[k]], 31))
                    rows.append([keys[k] if c == "key" else got[c] for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, _ARROW[_READ[c]]) for x, c in zip(zip(*rows, strict=True), columns, strict=True)], names=columns)
                lo = hi

    sorted_captures = captures.repartitionByRange("archive", "place").sortWithinPartitions("archive", "place")
    return sorted_captures.mapInArrow(read, ", ".join(f"{c} {_READ[c]}" for c in columns))


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct keys of the URLs of pages."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(key, "key string").distinct()


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write archives of all pages into the shared folder, look up all their URLs and read all captures back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    read = read_captures(lookup(keys_of(pages), path), path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
