"""Merkle fixity audit of archive replicas.

Each record of an archive file is hashed with its length; records are then hashed by ordered offset ranges of growing
size (64 KiB, 1 MiB, 16 MiB), and ranges up to the file's root. Two replicas are compared from the roots down: only
ranges below a mismatching one are compared, and only records of mismatching smallest ranges are joined, so what is
compared grows with the damage. Payloads are hashed where they are read; only digests are shuffled. Every level of a tree is
written once to the checkpoint folder, so that a comparison reads it and never builds it again.

``read_warc`` reads archive files (plain, or compressed record by record) into rows; ``warc_record`` writes a record. A group holds the records of one range, at most its size over the smallest record; an archive file never is one group
of records. Defined results: ``changed`` (other bytes at an offset), ``missing`` (only in the first replica) and
``extra`` (only in the second); null payloads are empty; repeated rows at one offset are compared as a sorted list;
null file names or offsets are places of their own; an empty replica makes all the other's records missing or extra;
two empty ones give no rows. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, slices

#: Bytes of one range at each level, smallest first.
RANGES = (1 << 16, 1 << 20, 1 << 24)


def digest_records(archive: DataFrame, file: Column, offset: Column, payload: Column) -> DataFrame:
    """(file, offset, length, digest): one row per place."""
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = archive.select(file.alias("file"), offset.cast("long").alias("offset"), F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"))
    places = rows.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("digest", "length"))).alias("all"))
    one = F.size("all") == 1
    joined = F.sha2(F.array_join(F.transform("all", lambda r: r["digest"]), ","), 256)
    return places.select("file", "offset", F.aggregate("all", F.lit(0).cast("long"), lambda n, r: n + r["length"]).alias("length"), F.when(one, F.col("all")[0]["digest"]).otherwise(joined).alias("digest"))


def _level(nodes: DataFrame, size: int | None) -> DataFrame:
    """Nodes of the next level from (file, at, digest); ``size`` None: the file's root."""
    at = F.lit(0).cast("long") if size is None else F.floor(F.col("at") / size).cast("long") * size
    children = nodes.groupBy("file", at.alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("below"))
    written = F.array_join(F.transform("below", lambda c: F.concat(F.coalesce(c["at"].cast("string"), F.lit("-")), F.lit(":"), c["digest"])), ",")
    return children.select("file", F.col("up").alias("at"), F.sha2(written, 256).alias("digest"))


def build_tree(records: DataFrame, ranges: tuple[int, ...] = RANGES) -> list[DataFrame]:
    """The levels from the records up to one root per file, each written once."""
    levels = [checkpointed(records.select("file", F.col("offset").alias("at"), F.sha2(F.concat_ws(":", "length", "digest"), 256).alias("digest")))]
    for size in (*ranges, None):
        levels.append(checkpointed(_level(levels[-1], size)))
    return levels


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    a, b = (x.select("file", "at", F.col("digest").alias(d)) for x, d in ((one, "one"), (two, "two")))
    same = F.col("a.file").eqNullSafe(F.col("b.file")) & F.col("a.at").eqNullSafe(F.col("b.at"))
    return a.alias("a").join(b.alias("b"), same, "full").where(~F.col("one").eqNullSafe(F.col("two"))).select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.at", "b.at").alias("at"), "one", "two")


def audit(first: DataFrame, second: DataFrame, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    """(file, offset, status) of every place where two replicas' records (from ``digest_records``) differ."""
    trees = [build_tree(x, ranges) for x in (first, second)]
    sizes = (*ranges, None)
    wrong = checkpointed(_differing(trees[0][-1], trees[1][-1]))
    for level in range(len(sizes) - 1, -1, -1):
        bad, size = wrong.select(F.col("file").alias("bad_file"), F.col("at").alias("bad_at")), sizes[level]
        up = F.lit(0).cast("long") if size is None else F.floor(F.col("at") / size).cast("long") * size
        below = [t[level].join(bad, F.col("file").eqNullSafe(F.col("bad_file")) & up.eqNullSafe(F.col("bad_at")), "left_semi") for t in trees]
        wrong = checkpointed(_differing(*below))
    return wrong.select("file", F.col("at").alias("offset"), F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("changed").alias("status"))


#: The time that records written here carry.
WARC_DATE = "1970-01-01T00:00:00Z"


def warc_record(url: Column, body: Column, name: Column, date: str = WARC_DATE) -> Column:
    """A WARC 1.0 resource record as text; its octet length is its size in the file. Its id is made from ``name``."""
    body, key = F.coalesce(body, F.lit("")), F.md5(name.cast("binary"))
    urn = F.concat_ws("-", *(F.substring(key, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = [F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), urn, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string")]
    return F.concat(*head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


#: Compressed bytes that are unpacked at once.
_CHUNK = 1 << 16
WARC_FIELDS = "file string, offset long, type string, record_id string, uri string, payload binary, error string"


def _next_record(data: bytes, at: int) -> int:
    """The first place after ``at`` at which a record can begin: a version line after a line's end, or a compressed record's mark."""
    found = [x + skip for x, skip in ((data.find(b"\nWARC/", at), 1), (data.find(b"\x1f\x8b\x08", at + 1), 0)) if x >= 0]
    return min(found, default=len(data))


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the file, headers by lower-case name, payload) of each record.

    Bytes that are no record, a length that is no number, a record cut short and a damaged compressed record give a row with the header ``error``
    and what was found there; reading goes on where the next record can begin.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        error, start, after = None, at, None
        record: bytes = data
        if data[at : at + 2] == b"\x1f\x8b":  # a record compressed on its own
            unpack, parts, end = zlib.decompressobj(31), [], at
            try:
                while end < len(data) and not unpack.eof:
                    parts.append(unpack.decompress(view[end : end + _CHUNK]))
                    end = min(len(data), end + _CHUNK)
                error = None if unpack.eof else "compressed record cut short"
            except zlib.error as e:
                error = f"compressed record: {e}"
            record, start, after = b"".join(parts), 0, end - len(unpack.unused_data)
        head = record.find(b"\r\n\r\n", start) if record.startswith(b"WARC/", start) else -1
        if head < 0:
            after = _next_record(data, at) if after is None or error else after
            yield at, {"error": error or "no record"}, data[at:after]
            at = after
            continue
        lines = (line.split(":", 1) for line in record[start:head].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        headers = {k.strip().lower(): v.strip() for k, v in lines}
        size = headers.get("content-length", "0")
        end = head + 4 + int(size) if size.isdecimal() else len(record)
        if not size.isdecimal():
            error = error or f"content length {size!r}"
        elif end > len(record):
            error = error or "record cut short"
        elif after is None and end < len(data) and data[end : end + 4] != b"\r\n\r\n":
            error = error or "no end where the length says"
        if error and (after is None or error.startswith("compressed")):
            after = _next_record(data, head if after is None else at)
            end = min(end, after) if record is data else end
        yield at, headers | ({"error": error} if error else {}), record[head + 4 : end]
        at = end + 4 if after is None else after


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of archive files, damaged ones with ``error``. A task holds one file, which by custom has at most a gigabyte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in WARC_FIELDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in slices(batches, 1):
            rows = []
            for offset, headers, payload in parse_warc(batch.column(1)[0].as_py()):
                rows.append((batch.column(0)[0].as_py(), offset, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), payload, headers.get("error")))
                if len(rows) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, WARC_FIELDS)


#: Page ids per archive file of the query.
FILE_PAGES = 256


def _replica(pages: DataFrame, body: Column, lost: Column) -> DataFrame:
    """(page_id, file, offset, payload) of a replica of the pages' archive; a lost record leaves a hole in its file."""
    file = F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096))).cast("long")
    record = warc_record(F.col("url"), body, F.concat_ws(" ", "page_id", "url"))
    before = Window.partitionBy("file").orderBy("page_id", "order").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select("page_id", file.alias("file"), F.xxhash64("url", "html").alias("order"), F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("payload"), lost.alias("lost"))
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).where(~F.coalesce("lost", F.lit(False)))


def op7_merkle_fixity(pages: DataFrame) -> DataFrame:
    """Audits a damaged replica of the pages' archive: page_id % 50 = 7 lost their first character, page_id % 125 = 60 are gone.

    Each replica is laid out and hashed on its own: pages lie in files of FILE_PAGES ids, by id (then by bytes), null ids by
    hash in files of their own. Returns page_id, file, record_offset and status of every damaged record.
    """
    body = F.coalesce("html", F.lit(""))
    # a page whose body loses its first character: as many bytes as before, the rest intact
    worse = F.concat(F.rpad(F.lit(""), F.octet_length(F.substring(body, 1, 1)), "~"), F.expr("substr(coalesce(html, ''), 2)"))
    spoilt = F.when(F.col("page_id") % 50 == 7, worse).otherwise(body)
    placed = checkpointed(_replica(pages, body, F.lit(False)))
    second = _replica(pages, spoilt, F.col("page_id") % 125 == 60)
    records = [x.select("file", "offset", F.col("size").alias("length"), F.col("payload").alias("digest")) for x in (placed, second)]
    return placed.select("page_id", "file", "offset").join(audit(*records), ["file", "offset"]).select("page_id", "file", F.col("offset").alias("record_offset"), "status")


def op7_sql() -> str:
    """DuckDB SQL for the same rows (for tables without null ids or repeated pages), comparing every record."""
    crlf = "' || chr(13) || chr(10) || '"
    key = "md5(concat_ws(' ', page_id, url))"
    urn = " || '-' || ".join(f"substr({key}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    record = f"'WARC/1.0{crlf}WARC-Type: resource{crlf}WARC-Record-ID: <urn:uuid:' || {urn} || '>{crlf}WARC-Date: {WARC_DATE}{crlf}WARC-Target-URI: ' || coalesce(url, '') || '{crlf}Content-Type: text/html{crlf}Content-Length: ' || strlen(_) || '{crlf}{crlf}' || _ || '{crlf}{crlf}'"
    one, two = record.replace("|| _ ||", "|| body ||").replace("(_)", "(body)"), record.replace("|| _ ||", "|| worse ||").replace("(_)", "(worse)")
    return f"""
WITH bodies AS (SELECT page_id, url, coalesce(html, '') AS body, repeat('~', strlen(coalesce(html, '')[1])) || substr(coalesce(html, ''), 2) AS worse FROM pages),
records AS (SELECT page_id, CAST(floor(page_id / {FILE_PAGES}) AS BIGINT) AS file, {one} AS one, {two} AS two FROM bodies),
placed AS (SELECT *, CAST(coalesce(sum(strlen(one)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM records)
SELECT page_id, file, record_offset, CASE WHEN page_id % 125 = 60 THEN 'missing' ELSE 'changed' END AS status FROM placed WHERE page_id % 125 = 60 OR (page_id % 50 = 7 AND one <> two)
"""
