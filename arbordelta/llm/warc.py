"""WARC output with revisit records, and a reader that proves record boundaries by their chain.

Writing: of the pages whose payloads are equal and at least `least` bytes long, the one with the smallest page_id is a
response record, the others are revisit records without the payload. Archives are gzipped, cut at about `archive_bytes`.

Reading: every place in an archive where a version line stands is a candidate, wherever it is, also inside a payload;
each candidate names its successor, the offset after its Content-Length. Pointer jumping from the start of the archive,
in a number of rounds that is the logarithm of the records', keeps the candidates that the chain reaches; others are payload bytes.
An archive whose chain doesn't end at its end is an error.

Defined cases: null html is an empty payload; null page_ids are kept, and are neither referred to nor revisits; rows that
repeat the smallest page_id are all responses; null urls leave the target out; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, text_or_empty

SALTS = 16
VERSION = b"WARC/1.1\r\n"


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digest, refers_to of the pages that become revisit records. Carries no payloads."""
    light = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    # A digest may be that of a third of all pages, so both sides carry a salt.
    salted = light.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(firsts, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z") -> None:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = rows.join(revisits(rows, least).hint("merge"), ["page_id", "digest"], "left")

    def run(batches):
        shard, number, filled = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to")]
            for at in range(0, batch.num_rows, 256):
                archives, records = [], []
                for page_id, url, html, digest, refers_to in zip(*(c.slice(at, 256).to_pylist() for c in columns)):
                    size = len(html.encode())
                    body = html if refers_to is None else ""
                    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
                    if url is not None:
                        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
                    if refers_to is not None:
                        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
                    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size if body else 0}"]
                    record = "\r\n".join(head) + "\r\n\r\n" + body + "\r\n"  # the sink's line end is the last one
                    archives.append(f"{shard}-{number}")
                    records.append(record)
                    filled += len(record) + (size if body else 0)
                    if filled > 2 * archive_bytes:
                        number, filled = number + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(archives), pa.array(records)], ["archive", "record"])

    arrow_map(rows, run, "archive string, record string").write.options(lineSep="\r\n", compression="gzip").partitionBy("archive").text(path)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[dict[bytes, bytes]], list[tuple[int, int]]]:
    """Offsets of version lines, the successor that each names (-1: none), headers, and where each body lies."""
    at, after, heads, bodies = [], [], [], []
    found = data.find(VERSION)
    while found >= 0:
        end = data.find(b"\r\n\r\n", found)
        head = dict(line.split(b": ", 1) for line in data[found + len(VERSION) : end].split(b"\r\n") if b": " in line) if end >= 0 else {}
        length = head.get(b"Content-Length", b"")
        start = end + 4
        stop = start + int(length) if length.isdigit() else -1
        at.append(found)
        after.append(stop + 4 if 0 <= stop and data[stop : stop + 4] == b"\r\n\r\n" else -1)
        heads.append(head)
        bodies.append((start, stop))
        found = data.find(VERSION, found + 1)
    return np.array(at, np.int64), np.array(after, np.int64), heads, bodies


def reachable(at: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Which candidates the chain from offset 0 passes, by pointer jumping; an error if it doesn't end at `end`."""
    n = len(at)
    if end == 0:
        return np.zeros(0, bool)
    # Slot n stands for the archive's end, n + 1 for nowhere; both point to themselves.
    slot = np.searchsorted(at, after)
    jump = np.where((slot < n) & (at[np.minimum(slot, n - 1)] == after), slot, np.where(after == end, n, n + 1)) if n else np.zeros(0, np.int64)
    jump = np.concatenate([jump, [n, n + 1]])
    reach = np.zeros(n + 2, bool)
    reach[0 if n and at[0] == 0 else n + 1] = True
    while True:
        grown = reach.copy()
        grown[jump[reach]] = True
        if (grown == reach).all():
            break
        reach, jump = grown, jump[jump]
    if reach[n + 1] or not reach[n]:
        raise ValueError("the chain of records doesn't end at the end of the archive")
    return reach[:n]


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"


def read(spark: SparkSession, path: str) -> DataFrame:
    def page(value: bytes | None) -> int | None:
        number = (value or b"").strip(b"<>").rpartition(b":")[2]
        return int(number) if number else None

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                at, after, heads, bodies = candidates(data)
                rows = []
                for k in np.flatnonzero(reachable(at, after, len(data))).tolist():
                    head, (start, stop) = heads[k], bodies[k]
                    said, kind = head[b"WARC-Payload-Digest"].rpartition(b":")[2].decode(), head[b"WARC-Type"].decode()
                    size, digest = int(head[b"WARC-Payload-Length"]), said
                    if kind == "response":
                        size, digest = stop - start, hashlib.sha256(memoryview(data)[start:stop]).hexdigest()
                        if digest != said:
                            raise ValueError(f"{name}: the payload at {at[k]} is damaged")
                    rows.append((page(head[b"WARC-Record-ID"]), size, digest, kind, page(head.get(b"WARC-Refers-To")), name, int(at[k])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], [x.split()[0] for x in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return arrow_map(files, run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
