"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id and payload digest into shards, each shard is written by one task as gzip-per-record WARC
files that roll over at a compressed size, with headers and digests made anew. The commit has three steps, each of which
can be repeated: tasks write ``tmp/<name>.<attempt>``, and the rows they return (one per file) are the journal; only when
the journal is complete are the files it names renamed; and only the job that has renamed them all publishes the
manifest. A lost executor or a speculative attempt leaves a temporary file that no journal names. After a lost driver
``resume`` goes on from the journal, or clears away what had none. A folder that is in use is refused.

The same input gives the same bytes: the edges of the shards come from records chosen by their hashes with chances in
proportion to their bytes, dates are fixed, and a record's id is made of page id, payload digest and its number among the
records that have both in common.

Of equal payloads of at least ``min_revisit`` bytes one record, of the smallest id, is the response; the others are written
as ``revisit`` records without a block, which name it; their length is in the header. Reading back checks every digest.

Scale: the duplicates are found by a map-side combined aggregate over digests and joined to ids only, so that a hot
digest is split; payloads are shuffled once, into shards of about ``shard_bytes``, of which there are at most
``MAX_SHARDS``: beyond that shards grow, and files roll over as before. Edges are weighed by bytes and may fall between
payloads of one id or of the null id. A shard is streamed: no task holds more than an Arrow batch (64 MB) and one record.
The driver sees ``EDGE_SAMPLE`` keys a shard. Files go to any folder that pyarrow's file systems reach (file, hdfs, ...).

Defined results: null html counts as empty; null url is written as ``about:blank``; null ids sort first and are written
without an id; rows that repeat an id, or all of a row, are records of their own, and of those with one payload that the
smallest id has only the first by url is a response. Rows without an id revisit the response; where no row with their payload has
an id, nothing could name a response, and all are responses. Line breaks in urls are percent-escaped.
An empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import qualified, skew_join, text_of

SHARD_BYTES, ROLL_BYTES, MIN_REVISIT = 32 << 20, 32 << 20, 100
MAX_SHARDS, EDGE_SAMPLE = 20_000, 50
HEAD_BYTES = 600  # about what a record's headers add
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: int = 0) -> bytes:
    """One WARC record, uncompressed; ``number`` counts records of equal page id and digest."""
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    name = lambda i, k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{i} {digest} {k}')}>"
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        kind, more = "response", []
    else:
        block, kind = b"", "revisit"
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to, 0)), ("X-Refers-To-Page", str(refers_to))]
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id, number)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *([] if page_id is None else [("X-Page-Id", str(page_id))]), *more]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(first: str) -> bytes:
    block = f"software: tidewave\r\nformat: WARC File Format 1.1\r\nfirst-record: {first}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, 'info' + first)}>\r\nWARC-Date: {DATE}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records have equal bytes."""
    out = BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as f:
        f.write(raw)
    return out.getvalue()


_MANIFEST = "shard long, part long, temp string, name string, bytes long, records long, first_id long, last_id long, sha256 string"


def _shards(folder: str, roll_bytes: int, min_revisit: int):
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("temp", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        context = TaskContext.get()
        attempt = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}"
        now: dict = {}
        mark: tuple = (None, None, None, None)
        last, number = None, 0

        def close() -> list[pa.RecordBatch]:
            if "out" not in now:
                return []
            now.pop("out").close()
            row = {**now, "sha256": now["sha256"].hexdigest()}
            return [pa.RecordBatch.from_pylist([{k: row[k] for k in schema.names}], schema=schema)]

        for batch in batches:
            shard, pid, url, html, digest, refers = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                s, p, r = shard[i].as_py(), pid[i].as_py(), refers[i].as_py()
                if r is not None:  # a mark for the rows that follow
                    mark = (s, p, digest[i].as_py(), r)
                    continue
                key = (s, p, digest[i].as_py())
                r = mark[3] if mark[:3] == key else None
                last, number = key, number + 1 if key == last else 0
                payload = html[i].as_py().encode()
                if r is None and number and p is not None and len(payload) >= min_revisit:
                    r = p  # the response is the first of the rows that share id and payload
                data = _member(record(p, url[i].as_py(), payload, key[2], r, number))
                if now.get("shard") != s or now["bytes"] >= roll_bytes:
                    yield from close()
                    part = now["part"] + 1 if now.get("shard") == s else 0
                    name = f"part-{s:06d}-{part:05d}.warc.gz"
                    now = {"shard": s, "part": part, "name": name, "temp": f"tmp/{name}.{attempt}", "bytes": 0, "records": 0, "first_id": p, "last_id": p, "sha256": hashlib.sha256()}
                    now["out"] = store.open_output_stream(f"{top}/{now['temp']}", compression=None)
                    data = _member(_info(name)) + data
                now["out"].write(data)
                now["sha256"].update(data)
                now["bytes"] += len(data)
                now["records"] += 1
                now["last_id"] = p
        yield from close()

    return run


def _commit(folder: str):
    """Renames what the manifest names; done twice, it does nothing the second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for b in batches:
            for temp, name in zip(b.column("temp").to_pylist(), b.column("name").to_pylist(), strict=True):
                if store.get_file_info(f"{top}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{top}/{temp}", f"{top}/{name}")
                elif store.get_file_info(f"{top}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{top}/{name}")
            yield b

    return run


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) for payloads that a smaller id, or for a null id any id, has too; refers_to is the smallest. Payloads stay where they are."""
    light = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(text_of(html_col)).alias("size"), F.sha2(text_of(html_col), 256).alias("digest"))
    light = light.where(F.col("size") >= min_revisit).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("rows"), F.count("page_id").alias("named"))
    first = first.where("refers_to < last or named > 0 and named < rows").select("digest", "refers_to")
    return skew_join(light, first, ["digest"]).where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _edges(rows: DataFrame, n_shards: int, total: int) -> list[tuple[int, int, str]]:
    """Up to n_shards - 1 keys (0 if the id is null else 1, id, start of the digest) that cut ``rows`` (page_id, html, url, size) into shards of about as many bytes."""
    chance = F.col("size") * (EDGE_SAMPLE * n_shards / total)
    chosen = rows.where(F.xxhash64("page_id", "url", "size") / F.lit(2.0**64) + 0.5 < chance)
    keys = chosen.select("page_id", F.substring(F.sha2("html", 256), 1, 16).alias("digest")).distinct().collect()  # EDGE_SAMPLE * n_shards of them are to be expected
    keys = sorted((0, 0, r.digest) if r.page_id is None else (1, r.page_id, r.digest) for r in keys)
    return sorted({keys[i * len(keys) // n_shards] for i in range(1, n_shards)}) if keys else []


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _publish(spark: SparkSession, folder: str) -> DataFrame:
    """From a complete journal on: rename what it names, publish the manifest, clear away the rest."""
    store, top = _open(folder)
    if not _exists(store, f"{top}/manifest/_SUCCESS"):
        journal = spark.read.schema(_MANIFEST).parquet(f"{folder}/journal")
        journal.mapInArrow(_commit(folder), journal.schema).write.mode("overwrite").parquet(f"{folder}/manifest")
    for left in ("tmp", "journal"):
        if _exists(store, f"{top}/{left}"):
            store.delete_dir(f"{top}/{left}")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def resume(spark: SparkSession, folder: str) -> DataFrame | None:
    """Finishes a commit that was cut off and gives the manifest; if the writing itself was, clears the folder and gives None."""
    folder = qualified(spark, folder)
    store, top = _open(folder)
    if _exists(store, f"{top}/manifest/_SUCCESS") or _exists(store, f"{top}/journal/_SUCCESS"):
        return _publish(spark, folder)
    for left in ("tmp", "journal", "manifest"):
        if _exists(store, f"{top}/{left}"):
            store.delete_dir(f"{top}/{left}")
    return None


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Writes the archives and gives the manifest, one row per file, which is also in ``folder``/manifest as Parquet."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    store, top = _open(folder)
    if any(_exists(store, f"{top}/{x}") for x in ("tmp", "journal", "manifest")):
        raise FileExistsError(f"{folder} holds archives, or the rest of a run that was cut off: see resume")
    store.create_dir(f"{top}/tmp", recursive=True)
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    sized = given.withColumn("size", F.octet_length("html") + HEAD_BYTES)
    total = sized.agg(F.sum("size")).first()[0] or 0
    n_shards = int(min(max_shards, max(1, -(-total // shard_bytes))))
    edges = _edges(sized, n_shards, total) if n_shards > 1 else []

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:  # ids as text: pandas has no nulls among longs
        return pd.Series([bisect_right(edges, (0, 0, d) if i is None else (1, int(i), d)) for i, d in zip(ids, digests, strict=True)])

    rows = given.withColumn("digest", F.sha2("html", 256)).withColumn("refers_to", F.lit(None).cast("long"))
    # A revisit's mark travels as a row of its own that sorts just before the page, so that payloads are shuffled once.
    marks = revisits(pages, id_col, html_col, min_revisit).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    rows = rows.unionByName(marks).withColumn("shard", shard_of(F.col("page_id").cast("string"), F.col("digest")) if edges else F.lit(0))
    placed = rows.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url").select("shard", "page_id", "url", "html", "digest", "refers_to")
    placed.mapInArrow(_shards(folder, roll_bytes, min_revisit), _MANIFEST).write.parquet(f"{folder}/journal")
    return _publish(spark, folder)


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members, one record at a time."""
    held, unzip, raw = b"", zlib.decompressobj(31), bytearray()
    while True:
        chunk = held or data.read(1 << 20)
        held = b""
        if not chunk:
            if raw:
                raise ValueError("the archive ends within a record")
            return
        raw += unzip.decompress(chunk)
        if unzip.eof:
            held, unzip = unzip.unused_data, zlib.decompressobj(31)
            end = raw.index(b"\r\n\r\n")
            lines = raw[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            head = dict(x.split(": ", 1) for x in lines[1:])
            block = bytes(raw[end + 4 : end + 4 + int(head["Content-Length"])])
            if head["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                raise ValueError(f"block digest differs in {head['WARC-Record-ID']}")
            yield head, block
            raw = bytearray()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records that the manifest names; payload is null for revisits."""
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)))
        rows, held = [], 0
        for b in batches:
            for name in b.column("name").to_pylist():
                with store.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for head, block in records(f):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        payload, size, digest = None, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"payload digest differs in {head['WARC-Record-ID']}")
                        rows.append((number("X-Page-Id"), head["WARC-Target-URI"], payload, size, digest, head["WARC-Type"], number("X-Refers-To-Page")))
                        held += len(block)
                        if held > 16 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("name")
    n = min(MAX_SHARDS, max(1, files.count()))
    return files.repartition(n, "name").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
