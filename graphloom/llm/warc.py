"""Writing web archives with revisit records, and reading them back in parallel.

The archives are plain (not compressed) WARC files, so a file can be read in
splits.  A reader of a split can't tell a record from a payload that holds the
record magic.  So tasks emit every candidate with the offset at which the chain
of records that would begin there leaves the split; pointer jumping from each
file's start over these offsets finds the one true entry of every split, and
only what is reachable from there is read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hot_split_lookup, materialise, named, shared_dir

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_BYTES, FILE_BYTES, SPLIT_BYTES = 1000, 256 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, size long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, record_offset long"


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", length)]]
    return MAGIC + "\r\n".join(lines).encode() + END


def _line(url: str | None) -> str:
    """A header value: control characters percent-encoded, so that no url can break a line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    fields: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _line(url))] if url is not None else []
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if refers_to is None:
        return _head(fields, len(HTTP) + len(payload)) + HTTP + payload + END
    return _head([*fields, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)], len(HTTP)) + HTTP + END


def with_referrals(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds refers_to: of payloads that are equal and long enough, the largest page_id's.

    Winners of repeated payloads are broadcast while they are few; else the
    pages are shuffled by digest, hot digests split.
    """
    keyed = pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")).where(F.col("bytes") >= min_bytes)
    winners = keyed.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    winners = materialise(winners)
    if winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = pages.join(F.broadcast(winners.drop("n")), "digest", "left")
    else:
        joined = hot_split_lookup(pages, winners, "digest", "n", ["page_id", "url"]).drop("n")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per page into WARC files under ``folder``; the manifest (path, size, records).

    Every attempt of a task writes files of its own names, and only those of
    the attempt that succeeded get into the manifest.
    """
    whole = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), F.coalesce(named(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    ready = with_referrals(whole.withColumn("digest", F.sha1("payload"))).select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if out is None:
                    path = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc"
                    out, size, n = fs.open_output_stream(path), 0, 0
                    info = b"format: WARC File Format 1.1\r\n"
                    head = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], len(info))
                    size += out.write(head + info + END)
                size += out.write(record(row[0], row[1], row[2].as_py(), row[3], row[4], date))
                n += 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        cols = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "size", "records"])

    return materialise(ready.mapInArrow(run, MANIFEST))


class _Window:
    """Random reads over one file that keep the last stretch read."""

    def __init__(self, file, size: int, ahead: int = 1 << 20):
        self.file, self.size, self.ahead, self.at, self.data = file, size, ahead, 0, b""

    def get(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start < self.at or end > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(end - start, min(self.ahead, self.size - start)))
        return self.data[start - self.at : end - self.at]

    def header(self, at: int, most: int = 1 << 24) -> tuple[dict[str, str], int] | None:
        """Fields and end of a record header at this offset, if there is one."""
        reach = 2048
        while True:
            data = self.get(at, at + reach)
            if not data.startswith(MAGIC):
                return None
            stop = data.find(END)
            if stop >= 0:
                break
            if at + reach >= self.size or reach > most:
                return None
            reach *= 4
        fields = {}
        for line in data[len(MAGIC) : stop].decode("utf-8", "replace").split("\r\n"):
            name, sep, value = line.partition(":")
            if not sep:
                return None
            fields[name.strip().lower()] = value.strip()
        return (fields, at + stop + len(END)) if fields.get("content-length", "").isdigit() else None


def _next(window: _Window, at: int) -> int | None:
    """Offset behind the record at ``at``, if a well-formed one is there."""
    found = window.header(at)
    if not found:
        return None
    end = found[1] + int(found[0]["content-length"])
    return end + len(END) if end + len(END) <= window.size and window.get(end, end + len(END)) == END else None


def spread(splits: DataFrame, at: str, most: int = 100_000) -> DataFrame:
    """A task for each split: their rows are tiny, so adaptive execution would put many splits into one task."""
    splits = materialise(splits)
    return splits.repartition(max(1, min(splits.count(), most)), "path", at)


def split_exits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, at, exit) for every candidate record of every split: where its chain leaves the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, base = FileSystem.from_uri(path)
                with fs.open_input_file(base) as file:
                    stop = min(start + split_bytes, size)
                    window = _Window(file, size, split_bytes + (1 << 16))
                    data = window.get(start, stop + len(MAGIC) - 1)
                    found = [start + m.start() for m in re.finditer(re.escape(MAGIC), data)]
                    exits: dict[int, int] = {}
                    for at in reversed(found):  # a successor lies behind, so its exit is known
                        to = _next(window, at)
                        if to is not None:
                            exits[at] = exits.get(to, to) if to < stop else to
                n = len(exits)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(list(exits), pa.int64()), pa.array(list(exits.values()), pa.int64())], ["path", "at", "exit"])

    splits = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    return spread(splits, "start").mapInArrow(run, "path string, at long, exit long")


def reachable_entries(manifest: DataFrame, exits: DataFrame) -> DataFrame:
    """(path, at): where the chain from each file's start enters its splits, by pointer doubling."""
    jumps = materialise(exits)
    entries = materialise(manifest.where("size > 0").select("path", F.lit(0).cast("long").alias("at")))
    n = entries.count()
    while True:
        ahead = entries.join(jumps, ["path", "at"]).select("path", F.col("exit").alias("at"))
        entries = materialise(entries.unionByName(ahead).distinct())
        grown = entries.count()
        if grown == n:
            return entries
        n = grown
        to = jumps.select("path", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        jumps = materialise(jumps.join(to, ["path", "exit"]).select("path", "at", F.col("beyond").alias("exit")))


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per response or revisit record reachable from its file's start.

    A record on the way that is cut off or malformed is an error, as what
    stands behind it can't be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def page(value: str) -> int | None:
            digits = value.removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        for b in batches:
            for path, size, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows: list[tuple] = []
                fs, base = FileSystem.from_uri(path)
                with fs.open_input_file(base) as file:
                    window, stop = _Window(file, size, split_bytes + (1 << 16)), (at // split_bytes + 1) * split_bytes
                    while at < min(stop, size):
                        to = _next(window, at)
                        if to is None:
                            raise ValueError(f"{path}: no well-formed record at offset {at}")
                        fields, body = window.header(at)
                        kind = fields.get("warc-type")
                        if kind in ("response", "revisit"):
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            length, refers = int(fields["x-payload-length"]), None
                            if kind == "response":
                                block = window.get(body, to - len(END))
                                payload = block[block.index(END) + len(END) :]
                                length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            else:
                                refers = page(fields["warc-refers-to"])
                            rows.append((page(fields["warc-record-id"]), length, digest, kind, refers, fields.get("warc-target-uri"), path, at))
                        at = to
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    files = manifest.select("path", "size")
    entries = reachable_entries(manifest, split_exits(manifest, split_bytes)).join(files, "path").where("at < size")
    return spread(entries.select("path", "size", "at"), "at").mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as WARC into the shared folder and read the records back.

    A null html is an empty payload, a null id an empty record name.  Rows
    that repeat the largest id of a payload group are all responses; where all
    ids of a group are null there is nothing to refer to, and all are responses.
    Payloads of any length are written whole, and an empty table gives no row;
    further columns are passed over.
    """
    base = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, base, id_col, url_col, html_col))
