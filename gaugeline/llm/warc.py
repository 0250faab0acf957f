"""WARC archives: writing pages as records, and reading them back along verified record boundaries.

Writing uses Spark's own text writer: a record is a row, and the two line ends after it are the line
separator, so each file is a sequence of WARC/1.1 records and a lost task's output is never half there.

Reading deals the files out in byte ranges. A task looks for the record magic in its range, where it begins the
file or follows a blank line as every record does, and, for each place, works out from the header where the next
record would begin. Such magic in a payload is a candidate too; headers end at the next blank line, so those of
candidates don't overlap and a range is searched once, whatever it holds. Within a range the candidates are followed to where they leave it; between ranges, pointer jumping
from the start of each file doubles the hops each round. Only what is reached from a file's start is
a record; a range is then walked from its one reached place.

Defined results: a null html is an empty payload. Of the pages with equal payloads of at least
``least_bytes``, the one with the largest page_id is a response and the others revisit it; a null id is
the smallest. Rows that tie for the largest id are all responses. A null page_id is carried, a null url
gives no target but the page's own name. Line ends in urls are dropped. Extra columns are ignored. An
empty table gives no records. A record that doesn't lead to the end of its file, or whose payload doesn't
match its digest, raises an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm._common import map_columns, shared_dir, written

# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
BLANK = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RANGE = 8 << 20  # bytes of an archive that one task takes
BROADCAST_GROUPS = 50_000  # groups of equal payloads, of under 100 bytes each
SALTS = 32


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and n_bytes of each page."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, urls, htmls in batches:
            payloads = [(h or "").encode("utf-8", "replace") for h in htmls]
            yield [ids, urls, htmls, list(map(payload_digest, payloads)), list(map(len, payloads))]

    return map_columns(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, html string, digest string, n_bytes long")


def typed(pages: DataFrame, *, least_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """with_digests() and target, the page that a page revisits; null for responses.

    Only groups of two or more equal payloads are looked up. If there are few, they are broadcast and no page
    is shuffled; else pages and groups meet by digest and a salt, so a payload of very many pages is no hot key."""
    own = with_digests(pages)
    narrow = own.select("page_id", "digest", "n_bytes").where(F.col("n_bytes") >= least_bytes)
    groups = written(narrow.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest"), "payloads")
    if groups.limit(broadcast_groups + 1).count() <= broadcast_groups:
        joined = own.join(F.broadcast(groups), "digest", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisits = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", "digest", "n_bytes", F.when(revisits, F.col("largest")).alias("target"))


def record(date: str) -> Column:
    """A record, without the line ends after it, of a row of typed()."""
    md5 = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    uuid = F.regexp_replace(md5, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = F.coalesce(F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:none"))
    revisit = F.col("target").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.coalesce("html", F.lit(""))))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", "[\r\n]", ""), name)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("target").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One WARC file for each task, in a folder that must not exist."""
    typed(pages, least_bytes=least_bytes).select(record(date).alias("value")).write.option("lineSep", BLANK.decode()).text(folder)


def _open(path: str):  # noqa: ANN202
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class Window:
    """Bytes of a file from ``start`` on, read ahead a range at a time."""

    def __init__(self, path: str, start: int, size: int, ahead: int = RANGE):
        self.file, self.start, self.size, self.ahead = _open(path), start, size, ahead
        self.held = b""

    def need(self, end: int) -> None:
        """Reads on until the bytes before ``end``, or all of the file, are held."""
        end = min(end, self.size)
        while self.start + len(self.held) < end:
            at = self.start + len(self.held)
            self.held += self.file.read_at(min(max(self.ahead, end - at), self.size - at), at)

    def header(self, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
        """The fields of the record at ``at``, and where its block and the next record begin; None if there is none."""
        self.need(at + len(MAGIC))
        if not self.held.startswith(MAGIC, at - self.start):
            return None
        reach = 4096
        while True:
            self.need(at + reach)
            stop = self.held.find(BLANK, at - self.start, at - self.start + reach)
            if stop >= 0 or at + reach >= self.size:
                break
            reach *= 4
        if stop < 0:
            return None
        lines = self.held[at - self.start + len(MAGIC) : stop].split(b"\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        length = fields.get(b"content-length", b"")
        if not length.isdigit():
            return None
        block = self.start + stop + len(BLANK)
        after = block + int(length) + len(BLANK)
        return (fields, block, after) if after <= self.size else None


def leave(path: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """(place, where its chain leaves the range) of each candidate in bytes start to end that leads out of it."""
    first = max(0, start - len(BLANK))
    window = Window(path, first, size)
    window.need(end + len(MAGIC))
    after: dict[int, int] = {}
    at = 0 if start == 0 else window.held.find(BLANK + MAGIC) + len(BLANK)
    while (len(BLANK) <= at or start == 0) and first + at < end:
        if got := window.header(first + at):
            after[first + at] = got[2]
        found = window.held.find(BLANK + MAGIC, at)
        if found < 0:
            break
        at = found + len(BLANK)
    out: dict[int, int] = {}
    for place in sorted(after, reverse=True):
        goal = after[place]
        if goal >= end:
            out[place] = goal
        elif goal in out:
            out[place] = out[goal]
    return list(out.items())


def boundaries(chunks: DataFrame, tasks: int, most_ranges: int) -> DataFrame:
    """file and entry: the first record of each range that pointer jumping reaches from the file's start."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for files, paths, starts, ends, sizes in batches:
            found = [(f, a, b) for f, *x in zip(files, paths, starts, ends, sizes, strict=True) for a, b in leave(*x)]
            if found:
                yield list(map(list, zip(*found, strict=True)))

    hops = written(map_columns(chunks.repartition(tasks), run, "file long, place long, goal long"), "hops")
    reached = chunks.where("start = 0").select("file", F.lit(0).cast("long").alias("entry"))
    for _ in range((most_ranges - 1).bit_length()):
        further = reached.join(hops, (reached["file"] == hops["file"]) & (F.col("entry") == F.col("place"))).select(reached["file"], F.col("goal").alias("entry"))
        reached = written(reached.union(further), "reached")
        second = hops.select(F.col("file").alias("f2"), F.col("place").alias("p2"), F.col("goal").alias("g2"))
        hops = written(hops.join(second, (F.col("file") == F.col("f2")) & (F.col("goal") == F.col("p2"))).select("file", "place", F.col("g2").alias("goal")), "hops")
    return reached


def read_archives(spark: SparkSession, folder: str, *, range_bytes: int = RANGE) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of the folder's archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length")
    bounds = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)).alias("n"), F.max(F.ceil(F.col("length") / range_bytes)).alias("most")).first()
    if not bounds["n"]:
        return spark.createDataFrame([], schema)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    chunks = files.select(F.xxhash64("path").alias("file"), "path", start.alias("start"), "length").select("file", "path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"), F.col("length").alias("size"))
    tasks = min(int(bounds["n"]), 10_000)
    entries = boundaries(chunks, tasks, int(bounds["most"])).withColumn("start", (F.col("entry") - F.col("entry") % range_bytes))
    walks = chunks.join(entries, ["file", "start"]).select("path", "entry", "end", "size")

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for paths, begins, ends, sizes in batches:
            for path, at, end, size in zip(paths, begins, ends, sizes, strict=True):
                window, rows = Window(path, at, size), []
                while at < end:
                    if (got := window.header(at)) is None:
                        raise ValueError(f"no record at byte {at} of {path}")
                    fields, block, after = got
                    window.need(after)
                    body = window.held[block - window.start : after - len(BLANK) - window.start]
                    kind = fields[b"warc-type"].decode()
                    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    payload = body.partition(BLANK)[2]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"the payload at byte {at} of {path} isn't the one that was written")
                    page, refers = fields.get(b"x-page-id"), fields.get(b"warc-refers-to")
                    rows.append((int(page) if page else None, len(payload) if kind == "response" else int(fields[b"x-payload-length"]), digest, kind, int(refers.strip(b"<>").rpartition(b":")[2]) if refers else None))
                    if after - window.start > 4 * RANGE:  # what was read needn't be held
                        window = Window(path, after, size)
                    at = after
                if rows:
                    yield list(map(list, zip(*rows, strict=True)))

    return map_columns(walks.repartition(tasks), run, schema)


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    write_archives(pages, folder, least_bytes=least_bytes)
    return read_archives(pages.sparkSession, folder)


#: The query over pages in DuckDB; base32 is taken from the digest's bits, five at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    unhex(sha1(html))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS largest
  FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT
      + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT)::INT, 1)), '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM b
"""
