"""WARC archives with a two-level capture index.

Pages are range-partitioned and sorted by (reversed-host URL key, page id).
Each task writes one archive (a gzip member per record) and one index file:
capture lines in key order, packed into compressed blocks, then the sparse
directory of the blocks' first keys.  The table of files, at most
``MAX_FILES`` rows, is the upper level.  A lookup finds the files whose key range
holds a key, reads a file's directory, binary-searches it and reads only the
blocks and records needed, by byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import BROADCAST_IDS, at_most, cut, encoded, saved, slices
from assayflow.session import scratch_dir

MAX_FILES = 50_000
#: Captures of the archives for each task of a lookup.
TASK_CAPTURES = 4096
FILE_BYTES = 16 << 20
BLOCK_LINES = 512
FILES = "file_no long, first_key string, last_key string, index_path string, directory_at long, directory_bytes long, captures long"


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, then path and query: ``http://www.Example.org/a?b#c`` -> ``org,example,www)/a?b``.

    A null URL has the empty key; a text without a host is its own key.
    """
    url = F.coalesce(url, F.lit(""))
    head = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?"
    host = F.lower(F.regexp_extract(url, head, 1))
    rest = F.regexp_replace(F.regexp_replace(url, head, ""), "#.*$", "")
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _store(path: str):
    """File system and path inside it, for local, shared and remote folders alike."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------ records
def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only its length and digest."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    name = lambda x: "" if x is None else str(x)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name(page_id)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; a response whose payload does not fit its digest and length fails."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", x)) else None
    kind, digest, length = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (digest_of(payload) != digest or len(payload) != length):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return {"page_id": number(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": number(headers.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


# ------------------------------------------------------------------ writing
def _decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> tuple[DataFrame, int]:
    """Pages with key and, for those that revisit another, the response's id; total payload bytes."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    hashed = rows.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    light = saved(hashed.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    groups = light.filter(f"bytes >= {least_bytes}").groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    again = light.join(groups.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first"), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")))
    again = again.filter("not page_id <=> first").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct()
    again = cut(again)
    side = F.broadcast(again) if at_most(again, BROADCAST_IDS) else again
    out = hashed.join(side, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    kind = F.when(F.col("r_digest").isNull(), "response").otherwise("revisit").alias("kind")
    return out.select(url_key(F.col("url")).alias("key"), "page_id", "url", "payload", kind, F.col("first").alias("refers_to")), light.agg(F.sum("bytes")).first()[0] or 0


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write archives and their index under ``folder`` (a new shared scratch folder if none); returns the table of files.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response, the
    others revisit it.  A null payload is empty, a null id never is the smallest unless all are null, repeated rows
    each give a record (those of the response's id are responses).  A file name is used by one attempt of a task only,
    so a retried task leaves no half-written file in the table.
    """
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark, "warc")
    rows, total = _decided(pages, id_col, url_col, payload_col, least_bytes)
    n = max(1, min(MAX_FILES, -(-total // FILE_BYTES)))
    ordered = rows.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "url")
    arrow = _arrow(FILES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = _store(folder)
        name, archive, index = uuid.uuid4().hex, None, None
        lines: list[bytes] = []
        directory: list[tuple[str, int, int]] = []
        first = last = None
        at = index_at = captures = 0

        def flush() -> int:
            block = gzip.compress(b"\n".join(lines), 6, mtime=0)
            index.write(block)
            directory.append((json.loads(lines[0])[0], index_at, len(block)))
            lines.clear()
            return index_at + len(block)

        for cols in slices(batches, 64):
            for key, page_id, url, payload, kind, refers_to in zip(*(cols[c] for c in ("key", "page_id", "url", "payload", "kind", "refers_to"))):
                if archive is None:
                    store.create_dir(inside, recursive=True)
                    archive, index = store.open_output_stream(f"{inside}/{name}.warc.gz", compression=None), store.open_output_stream(f"{inside}/{name}.cdx", compression=None)
                    first = key
                data = encoded(payload)
                member = gzip.compress(record(page_id, url, data, digest_of(data), kind, refers_to), 6, mtime=0)
                archive.write(member)
                lines.append(json.dumps([key, page_id, at, len(member)]).encode())
                at, last, captures = at + len(member), key, captures + 1
                if len(lines) == block_lines:
                    index_at = flush()
        if archive is None:
            return
        if lines:
            index_at = flush()
        packed = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
        index.write(packed)
        index.close()
        archive.close()
        yield pa.RecordBatch.from_pylist(
            [{"file_no": 0, "first_key": first, "last_key": last, "index_path": f"{folder}/{name}.cdx", "directory_at": index_at, "directory_bytes": len(packed), "captures": captures}],
            schema=arrow,
        )

    return saved(ordered.mapInArrow(write, FILES), "files")


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


# ------------------------------------------------------------------ reading
class IndexFile:
    """One index file: its directory in memory, blocks by range read (the last one is kept)."""

    def __init__(self, path: str, at: int, size: int):
        self.store, inside = _store(path)
        self.file = self.store.open_input_file(inside)
        self.directory = json.loads(gzip.decompress(self.file.read_at(size, at)))
        self.first = [x[0] for x in self.directory]
        self.held: tuple[int, list] = (-1, [])
        self.archive = self.store.open_input_file(inside.removesuffix(".cdx") + ".warc.gz")

    def block(self, k: int) -> list:
        if self.held[0] != k:
            _, at, size = self.directory[k]
            self.held = (k, [json.loads(x) for x in gzip.decompress(self.file.read_at(size, at)).split(b"\n")])
        return self.held[1]

    def captures(self, key: str) -> Iterator[list]:
        """Lines of a key: from the block before the first that begins at or after the key, on while blocks begin with it."""
        k = max(0, bisect_left(self.first, key) - 1)
        while k < len(self.first) and self.first[k] <= key:
            lines = self.block(k)
            lo = bisect_left(lines, key, key=lambda x: x[0])
            while lo < len(lines) and lines[lo][0] == key:
                yield lines[lo]
                lo += 1
            k += 1

    def record(self, at: int, size: int) -> dict:
        return parse_record(gzip.decompress(self.archive.read_at(size, at)))

    def close(self) -> None:
        self.file.close()
        self.archive.close()


CAPTURES = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def lookup(files: DataFrame, keys: DataFrame, with_payload: bool = False) -> DataFrame:
    """All captures of the distinct URL keys in ``keys`` (one column), read through the index by range reads.

    A key without captures gives no row, a null key stands for the empty key.  A key with very many captures is
    read block by block, from each of its files in a task of its own.
    """
    held = files.collect()  # MAX_FILES rows at most
    table = sorted((r["first_key"], r["last_key"], r["index_path"], r["directory_at"], r["directory_bytes"]) for r in held)
    tasks = max(1, -(-sum(r["captures"] for r in held) // TASK_CAPTURES))  # the keys are tiny, the records behind them are not
    shared = files.sparkSession.sparkContext.broadcast((table, [x[1] for x in table]))
    wanted = keys.select(F.coalesce(F.col(keys.columns[0]), F.lit("")).alias("key")).distinct()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lasts = shared.value
        for cols in slices(batches, 4096):
            out = []
            for key in cols["key"]:
                k = bisect_left(lasts, key)
                while k < len(table) and table[k][0] <= key:
                    out.append((k, key))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["file_no", "key"])

    schema = CAPTURES + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = _arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = shared.value
        held, index, rows = -1, None, []
        for cols in slices(batches, 4096):
            for file_no, key in zip(cols["file_no"], cols["key"]):
                if file_no != held:
                    if index is not None:
                        index.close()
                    held, index = file_no, IndexFile(*table[file_no][2:])
                for _, _, at, size in index.captures(key):
                    got = index.record(at, size) | {"key": key}
                    rows.append({x: got[x] for x in names})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # several tasks may share a file: keys are spread by file and hash, then read in key order
    located = wanted.mapInArrow(locate, "file_no long, key string")
    return located.repartition(tasks, "file_no", F.expr(f"pmod(xxhash64(key), {max(4, -(-2 * tasks // max(1, len(table))))})")).sortWithinPartitions("file_no", "key").mapInArrow(read, schema)


def write_and_read_back(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages, then read every capture through the index: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, key.  One row per page row; an empty table gives an empty result."""
    files = write_archives(pages, id_col, url_col, payload_col, least_bytes)
    keys = pages.select(url_key(pages[url_col].cast("string")).alias("key"))
    return lookup(files, keys).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "key")
