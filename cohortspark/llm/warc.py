"""WARC archives with revisit records, and a two-level capture index over them.

write_warc() writes gzip members, one for each record, to archives in a shared folder; build_index() sorts the captures by
reversed-host URL key into compressed blocks and keeps a sparse directory of the blocks; locate() finds captures by binary
search in the directory, then in a block. Its tasks take sorted ranges of keys and read only what of the directory their keys
need. read_records() deals captures into ranges of (archive, offset), so that a task opens few archives and reads neighbours
together. fetch() is both; read_warc() reads all blocks without a search.

Paths are URIs that pyarrow.fs resolves on the executors. A file's name holds a random part, and only the names that a
finished task returned are used, so that a task that runs again leaves at most an unused file behind."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_dir, stash
from .textbytes import releasing

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query: http://www.a.com/x?y -> com,a)/x?y.

    Scheme, user, port, fragment and a leading www. are dropped and the host is in lower case; null and a URL without a host
    give `)` and what there is of the path."""
    text = url or ""
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host = (parts.hostname or "").lower()
    except ValueError:
        return ")" + text
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    return key + ("?" + parts.query if parts.query else "")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def link_of(url: str | None) -> str:
    """A URL as it is written: without white space; null is empty."""
    return "".join((url or "").split())


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _record(kind: str, page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[3:3] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


CAPTURE = "url_key string, page_id long, file string, offset long, length long, record_type string, refers_to long"


def first_of_copies(digests: DataFrame, min_bytes: int, share: int = 1000) -> DataFrame:
    """(rp, rd, first_id): pages that revisit a page with the same digest and size, and the least id of those pages.

    A payload of more than one in `share` rows is hot: fewer than `share` payloads can be, so that they are broadcast and their
    rows stay where they are; the rows of all other payloads meet their first one by a join on the digest."""
    most = digests.count() // share
    copies = digests.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows"))
    copies = stash(copies.where("rows > 1"), "copies")
    hot = F.broadcast(copies.where(F.col("rows") > most).drop("rows"))
    found = digests.join(hot, ["digest", "n"]).unionByName(digests.join(hot, ["digest", "n"], "left_anti").join(copies.where(F.col("rows") <= most).drop("rows"), ["digest", "n"]))
    later = found.where("page_id > first_id or page_id is null").select(F.col("page_id").alias("rp"), F.col("digest").alias("rd"), "first_id")
    revisits = stash(later.distinct(), "revisits")
    discard(copies)
    return revisits


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each page and returns its capture (url_key, page_id, file, offset, length, record_type, refers_to).

    Of records whose payloads of at least min_bytes bytes are equal, that with the smallest page_id is a response and the
    others are revisits of it; of several rows with that page_id and payload, all are responses. A null html is an empty
    payload; a null page_id is written as 'null' and comes last. Other columns are ignored."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    digests = stash(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n")), "digests")
    revisits = first_of_copies(digests, min_bytes)
    marked = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(revisits, F.col("page_id").eqNullSafe(F.col("rp")) & (F.col("digest") == F.col("rd")), "left")
    fs, root = filesystem(folder)
    fs.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                got = []
                for pid, link, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload, link = text.encode(), link_of(link)
                    kind = "response" if first is None else "revisit"
                    data = _gzip(_record(kind, pid, link, payload, digest32(payload), first))
                    out.write(data)
                    got.append((url_key(link), pid, name, at, len(data), kind, first))
                    at += len(data)
                yield _batch(got, CAPTURE)
        finally:
            if out is not None:
                out.close()

    captures = stash(marked.select("page_id", "url", "html", "first_id").mapInArrow(releasing(write), CAPTURE), "captures")
    discard(digests)
    discard(revisits)
    return captures


DIRECTORY = "first_key string, first_id long, last_key string, file string, offset long, length long, n int"


def build_index(captures: DataFrame, folder: str, block_rows: int = 500) -> DataFrame:
    """Level one: captures in the order of (url_key, page_id), in zlib blocks of block_rows lines in files under folder.
    Level two, returned: a row for each block (first and last key, file, offset, length, number of lines).

    The range of keys is split among tasks by (url_key, page_id), so that a hot host or URL is split too."""
    fs, root = filesystem(folder)
    fs.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, out, at, held, made = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            out.write(data)
            made.append((held[0][0], held[0][1], held[-1][0], name, at, len(data), len(held)))
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(list(row))
                if len(held) == block_rows:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        yield _batch(made, DIRECTORY)

    ordered = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return stash(ordered.mapInArrow(releasing(write), DIRECTORY), "directory")


def read_block(fs: pafs.FileSystem, path: str, offset: int, length: int) -> list[list]:
    with fs.open_input_file(path) as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]


def parse_record(data: bytes) -> dict:
    """Headers of one gzip member's WARC record and its HTTP block: type, id, url, digest, refers_to, length, payload."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x.strip("<>").rpartition(":")[2])
    return {
        "record_type": fields["WARC-Type"], "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": int(said["Content-Length"]), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


LOCATION = "file string, offset long, length long"
#: Bytes that are read from an archive together, and bytes of archives for a task; no stage has more than MOST_TASKS tasks.
RUN_BYTES, TASK_BYTES, MOST_TASKS = 4 << 20, 64 << 20, 20_000


def runs_of(places: list[tuple[str, int, int]], most: int = RUN_BYTES) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbours in sorted (file, offset, length): same archive, less than 64 KB apart, up to `most` bytes from first to last. A
    longer record stands alone."""
    run: list[tuple[str, int, int]] = []
    for place in places:
        if run and (place[0] != run[-1][0] or place[1] > run[-1][1] + run[-1][2] + (64 << 10) or place[1] + place[2] - run[0][1] > most):
            yield run
            run = []
        run.append(place)
    if run:
        yield run


def _tasks(spark: SparkSession, work: int, each: int) -> int:
    """Tasks for an amount of work; rows are so small here that Spark's own choice would be one task."""
    return max(spark.sparkContext.defaultParallelism, min(-(-work // each), MOST_TASKS))


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records at captures (file, offset, length; other columns are ignored), a response's payload checked against its digest
    (a mismatch raises). A revisit's payload is that of the record it refers to.

    Places are stored once and dealt into ranges of (file, offset) of about 64 MB of archives, so that few tasks open an archive;
    neighbouring records are read together."""
    schema = RECORD + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    places = stash(captures.select("file", "offset", "length"), "places")
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        opened, last = None, None
        try:
            for batch in batches:
                for run in runs_of(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                    file, begin = run[0][:2]
                    if file != last:
                        if opened:
                            opened.close()
                        opened, last = fs.open_input_file(f"{root}/{file}"), file
                    data, rows = opened.read_at(max(at + n for _, at, n in run) - begin, begin), []
                    for _, at, n in run:
                        record = parse_record(data[at - begin : at - begin + n])
                        if record["payload"] is not None and digest32(record["payload"]) != record["payload_digest"]:
                            raise ValueError(f"payload of page {record['page_id']} does not match its digest")
                        rows.append(tuple(record[x] for x in names))
                    yield _batch(rows, schema)
        finally:
            if opened:
                opened.close()

    dealt = places.repartitionByRange(_tasks(places.sparkSession, size, TASK_BYTES), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(releasing(read), schema)


def read_warc(directory: DataFrame, index_folder: str, folder: str, payload: bool = False) -> DataFrame:
    """All records, by the captures of all blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(index_folder)
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([(x[2], x[3], x[4]) for x in read_block(fs, f"{root}/{name}", offset, length)], LOCATION)

    blocks = directory.select("file", "offset", "length")
    blocks = blocks.repartition(_tasks(directory.sparkSession, directory.count(), 64), "file", "offset")
    return read_records(blocks.mapInArrow(releasing(read), LOCATION), folder, payload)


def _place(key: str, page_id: int | None) -> tuple:
    """Captures are in the order of this; null ids come first."""
    return key, page_id is not None, page_id or 0


def locate(keys: DataFrame, directory: DataFrame, index_folder: str) -> DataFrame:
    """The captures (CAPTURE) of keys (url, and page_id if there is such a column): binary search in the directory, then in the blocks.

    Keys are sorted in ranges, and a task reads the directory only between the least and the greatest key of a batch. A key that
    stands several times is one; without page_id all captures of a URL are found. Keys without captures give no rows."""
    exact, path = "page_id" in keys.columns, directory._stashed

    def key_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([url_key(link_of(u)) for u in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([own, batch.column(1)], ["url_key", "page_id"])

    def blocks_between(lo: str, hi: str) -> list[tuple]:
        fs, root = filesystem(path)
        found = pads.dataset(root, filesystem=fs, format="parquet").to_table(filter=(pads.field("first_key") <= hi) & (pads.field("last_key") >= lo))
        rows = zip(*(found[c].to_pylist() for c in ("first_key", "first_id", "file", "offset", "length")), strict=True)
        return sorted((_place(key, i), file, offset, length) for key, i, file, offset, length in rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(index_folder)
        for batch in batches:
            wanted = [_place(k, i) if exact else (k,) for k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if not wanted:
                continue
            blocks, lines, loaded = blocks_between(wanted[0][0], wanted[-1][0]), [], (-1, [], [])
            firsts = [b[0] for b in blocks]
            for key in wanted:
                # lines like the first of a block may stand at the end of the one before
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(blocks) and firsts[k][: len(key)] <= key:
                    if loaded[0] != k:
                        held = read_block(fs, f"{root}/{blocks[k][1]}", blocks[k][2], blocks[k][3])
                        loaded = k, held, [_place(x[0], x[1]) for x in held]
                    at = bisect.bisect_left(loaded[2], key)
                    while at < len(loaded[2]) and loaded[2][at][: len(key)] == key:
                        lines.append(loaded[1][at])
                        at += 1
                    k += 1
            yield _batch(lines, CAPTURE)

    page = F.col("page_id").cast("long") if exact else F.lit(None).cast("long")
    keyed = keys.select(F.col("url").cast("string").alias("url"), page.alias("page_id")).mapInArrow(releasing(key_of), "url_key string, page_id long")
    ordered = keyed.distinct().repartitionByRange(_tasks(keys.sparkSession, directory.count(), 64), "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return ordered.mapInArrow(releasing(read), CAPTURE)


def fetch(keys: DataFrame, directory: DataFrame, index_folder: str, folder: str, payload: bool = False) -> DataFrame:
    """The records of the captures of keys, as locate() finds them; the places of the captures are stored in between."""
    return read_records(locate(keys, directory, index_folder), folder, payload)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives with their index and fetches every record by its key through it."""
    spark = pages.sparkSession
    archives, index = fresh_dir(spark, "warc"), fresh_dir(spark, "index")
    directory = build_index(write_warc(pages, archives, min_bytes), index)
    return fetch(pages.select("url", "page_id"), directory, index, archives)
