"""WARC records of web pages, and a Merkle fixity audit of two replicas.

Pages become WARC 1.1 response records in files by ranges of FILE_RECORDS ids, each with its byte offset. The audit
hashes every record (SHA-256 of its bytes) and builds, file by file, a tree over ranges of record identities: a
record's leaf is its slot (page_id within the file's range of ids) and its occurrence among the slot's records, so
a lost record doesn't shift the others. A node's digest covers the identity, the offsets from the node's start and
the digest of each of up to FANOUT children; a tree over the files' roots ends in one root. Two replicas are
compared from the root down: only children of mismatching nodes are looked at, so intact branches cost nothing.

Records of the leaves reached are matched by page_id: equal bytes first, the others in the order of their digests.
What only one replica has is missing or extra, a pair of unequal bytes is corrupt. Records of equal bytes at other
offsets (those after a lost one in its file, say) are moved; they are looked for in files with a mismatching root.

Every level is a groupBy on (file, parent), so no task holds more than FANOUT children of a node, and
a level has a FANOUT-th of the rows of the one below. Equal records are counted before they are dealt, and offsets come from
sums over cells (file, page_id, first byte of the digest), so a page_id with very many records isn't one task's work. Offsets
never depend on other files.

Cases: null url or html count as empty; rows without page_id are dealt to NAMELESS files by their digest (file is null) and have
no identity but their bytes; ids may be negative, sparse or repeated: a file has at most FILE_RECORDS different ids, and as many
records as these have; repeated rows are records of their own, in the order of page_id and digest; very long pages are hashed on the
JVM, one record at a time; columns other than page_id, url and html are not read, whatever their names; an empty table
has no root and no finding.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import stash

FANOUT = 16
FILE_RECORDS = 1024  # a power of 2
SLOT_LEVELS = 3  # FANOUT ** SLOT_LEVELS >= FILE_RECORDS
LEAF = ["no", "slot", "occ"]
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page's response record as text (UTF-8 when stored)."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(html, F.lit("")))
    head = [F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


#: Files of records without page_id.
NAMELESS = 4096


def hex_of(digest: str, at: int, n: int) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("long")


def records(pages: DataFrame) -> DataFrame:
    """Stored (no, file, pos, page_id, slot, occ, copy, start, end, digest): pages as WARC records in files by ranges of page_id.

    no numbers files from 0 up: even ones hold ids (4 * file, or -4 * file - 2 if it is negative), odd ones records without any.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"))
    rows = rows.groupBy("page_id", "digest", "size").agg(F.count("*").alias("n"))
    none = F.col("page_id").isNull()
    file = F.shiftright("page_id", FILE_RECORDS.bit_length() - 1)  # floors, also below 0; no doubles, which lose large ids
    rows = rows.withColumns({"file": file, "id": F.coalesce("page_id", F.lit(0)), "cut": F.when(none, "").otherwise(F.substring("digest", 1, 2))})
    no = F.when(none, 2 * (hex_of("digest", 1, 3) % NAMELESS) + 1).when(F.col("file") >= 0, 4 * F.col("file")).otherwise(-4 * F.col("file") - 2)
    slot = F.when(none, hex_of("digest", 4, 2)).otherwise(F.col("page_id") - F.col("file") * FILE_RECORDS)
    rows = stash(rows.withColumns({"no": no, "slot": slot}), "bytes")
    cell = ["no", "id", "cut"]
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*cell).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("size")).alias("_b"))
    w = Window.partitionBy("no").orderBy("id", "cut")
    cells = cells.select(*cell, before(w, "_n").alias("pos0"), before(w, "_b").alias("start0"), before(Window.partitionBy("no", "id").orderBy("cut"), "_n").alias("occ0"))
    w = Window.partitionBy(*cell).orderBy("digest")
    local = {"pos1": before(w, F.col("n")), "start1": before(w, F.col("n") * F.col("size")), "occ1": before(Window.partitionBy(*cell, "slot").orderBy("digest"), F.col("n"))}
    rows = rows.withColumns(local).join(cells, cell).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("start0") + F.col("start1") + F.col("copy") * F.col("size")
    place = [(F.col("pos0") + F.col("pos1") + F.col("copy")).alias("pos"), "page_id", "slot", (F.col("occ0") + F.col("occ1") + F.col("copy")).alias("occ"), "copy", start.alias("start"), (start + F.col("size")).alias("end")]
    return stash(rows.select("no", "file", *place, "digest"), "records")


def parent(by: str) -> Column:
    return F.floor(F.col(by) / FANOUT).cast("long")


def grow(nodes: DataFrame, key: list[str], by: str) -> DataFrame:
    """The level above: nodes (key, start, end, digest) -> the same for their parents, ranges of FANOUT in column `by`."""
    rest = [k for k in key if k != by]
    up = nodes.groupBy(*rest, parent(by).alias("_up")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct(by, F.col("start").alias("s"), F.col("end").alias("e"), "digest"))).alias("kids"))
    parts = F.transform("kids", lambda k: F.concat_ws(":", k[by].cast("string"), (k["s"] - F.col("start")).cast("string"), (k["e"] - F.col("start")).cast("string"), k["digest"]))
    return up.select(*rest, F.col("_up").alias(by), "start", "end", F.sha2(F.array_join(parts, "|"), 256).alias("digest"))


def height(n: int) -> int:
    """Levels above the leaves 0 .. n."""
    k = 0
    while n:
        n //= FANOUT
        k += 1
    return k


def tree(leaves: DataFrame, occ_levels: int, file_levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels from the leaves up: (no, slot, occ, start, end, digest) within files, (pos, ...) over the files' roots."""
    within = [leaves.select(*LEAF, "start", "end", "digest")]
    for by in ["occ"] * occ_levels + ["slot"] * SLOT_LEVELS:
        within.append(stash(grow(within[-1], LEAF, by), "tree"))
    over = [within[-1].select(F.col("no").alias("pos"), "start", "end", "digest")]
    for _ in range(file_levels):
        over.append(stash(grow(over[-1], ["pos"], "pos"), "tree"))
    return within, over


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes that only one replica has, or whose length or digest differ."""
    size = F.col("end") - F.col("start")
    x, y = a.select(*keys, size.alias("n1"), F.col("digest").alias("d1")), b.select(*keys, size.alias("n2"), F.col("digest").alias("d2"))
    same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("d1").eqNullSafe(F.col("d2"))
    return x.join(y, keys, "full").where(~same).select(*keys)


def descend(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Mismatching leaves (no, slot, occ) and files (no) of two replicas, and the mismatching nodes of each level from the root down."""
    most = [r.agg(F.max("occ"), F.max("no")).first() for r in (a, b)]
    occ_levels, file_levels = (height(max(m[i] or 0 for m in most)) for i in (0, 1))
    (within_a, over_a), (within_b, over_b) = tree(a, occ_levels, file_levels), tree(b, occ_levels, file_levels)
    counts: list[int] = []

    def step(x: DataFrame, y: DataFrame, keys: list[str], by: str, above: DataFrame | None) -> DataFrame:
        if above is not None:
            hit = above.withColumnRenamed(by, "_up")
            x, y = (t.withColumn("_up", parent(by)).join(hit, hit.columns, "left_semi") for t in (x, y))
        bad = stash(differing(x, y, keys), "bad")
        counts.append(bad.count())
        return bad

    bad = None
    for x, y in zip(reversed(over_a), reversed(over_b), strict=True):
        bad = step(x, y, ["pos"], "pos", bad)
        if not counts[-1]:
            break
    files = bad.select(F.col("pos").alias("no"))
    bad = files.select("no", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("occ"))
    for i in reversed(range(occ_levels + SLOT_LEVELS)):
        if not counts[-1]:
            break
        bad = step(within_a[i], within_b[i], LEAF, "occ" if i < occ_levels else "slot", bad)
    return bad, files, counts


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[int]]:
    """Leaves (no, slot, occ) in which two replicas (from `records`) differ, and the mismatching nodes of each level from the root down."""
    bad, _, counts = descend(a, b)
    return bad, counts


def findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of replica a or b: file, pos, page_id, start, end, digest (as in a, if it is there) and status."""
    bad, files, _ = descend(a, b)
    cols = ["file", "pos", "page_id", "start", "end", "digest"]
    there = [F.col(c).alias(f"{c}2") for c in cols]
    moved = F.when((F.col("start") != F.col("start2")) | (F.col("end") != F.col("end2")), "moved").otherwise("intact").alias("status")
    whole = a.join(files, "no", "left_anti").select(*cols, F.lit("intact").alias("status"))
    x, y = (t.join(files, "no", "left_semi") for t in (a, b))
    quiet = x.join(bad, LEAF, "left_anti").join(y.select(*LEAF, *there), LEAF).select(*cols, moved)
    # suspects: equal bytes of a page_id first (copy by copy), then what is left of it
    x, y = (stash(t.join(bad, LEAF, "left_semi").withColumn("id", F.coalesce("page_id", F.lit(0))), "suspects") for t in (x, y))
    w = Window.partitionBy("no", "id", "digest").orderBy("pos")
    x, y = (t.withColumn("copy", F.row_number().over(w)) for t in (x, y))
    key = ["no", "id", "digest", "copy"]
    equal = x.join(y.select(*key, *there[:5]), key).select(*cols, moved)
    u, v = (s.join(t, key, "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy("no", "id").orderBy("digest", "pos"))) for s, t in ((x, y), (y, x)))
    pairs = u.join(v.select("no", "id", "_r", *there), ["no", "id", "_r"], "full")
    status = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt").alias("status")
    damage = pairs.select(*[F.when(F.col("digest").isNull(), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in cols], status)
    return whole.unionByName(quiet).unionByName(equal).unionByName(damage)


#: What ends a WARC record; Spark's text sink writes it after each row.
END = "\r\n\r\n"


def write_warc(pages: DataFrame, path: str, file_records: int = 16 * FILE_RECORDS) -> None:
    """A folder of gzipped WARC files (plain WARC 1.1 within), by ranges of page_id, of at most file_records records each.

    It is Spark's text sink, so any file system and commit protocol that it has will do; each row is a record, and the line
    separator is the blank lines that end one.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.substring(text, F.lit(1), F.char_length(text) - 4).alias("value"))
    rows = rows.repartitionByRange(F.col("page_id").asc_nulls_first(), F.xxhash64("value")).sortWithinPartitions("page_id")
    rows.select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a WARC file, plain or of gzip members; ValueError where bytes are no whole record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(":", 1) for x in m[1].decode().split("\r\n"))
        head = {k.strip(): v.strip() for k, v in head.items()}
        end = m.end() + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        yield head, data[m.end() : end]
        at = end + 4


def read_warc(spark, path: str) -> DataFrame:
    """Pages (page_id, url, html) of a folder of WARC files: response records. Files from elsewhere have no page_id in their names' ids (null)."""

    def run(batches):
        import pyarrow as pa

        kind = "page_id url html".split()
        for b in batches:
            for data in b.column(0):
                out: list[tuple] = []
                for head, body in parse_warc(data.as_py()):
                    if head.get("WARC-Type") == "response":
                        key = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("WARC-Record-ID", ""))
                        out.append((int(key[1]) if key else None, head.get("WARC-Target-URI"), body.split(b"\r\n\r\n", 1)[-1].decode("utf-8", "replace")))
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, "page_id long, url string, html string")
