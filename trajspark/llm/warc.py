"""WARC archives: writing pages as records, and reading archives in many tasks by boundary-chain verification.

Writing. Each page is a `response` record whose block is a short HTTP head and the payload; of pages with equal payloads of at
least `least` bytes that with the largest page_id is the response and the others are `revisit` records without payload. Spark's
text writer commits the files, with CR LF CR LF, the end of a record, as line separator.

Reading. A file is split at every line that begins with the magic "WARC/1.", whether a record or a payload put it there, so
files of any size are read by several tasks. Each segment whose header is complete gives a candidate, an edge from its offset
to that of its successor (header + Content-Length + 4). A candidate is a record only if the chain from offset 0 reaches it:

- offsets: a split's own bytes are summed by its task, and the sums of the splits before it in its file are added;
- in each split, every candidate's chain is followed to the first offset outside of the split;
- pointer jumping over these few exits, from offset 0, doubling the jump each round: as many rounds as the logarithm of the
  splits of a file, whatever the number of records;
- in each split again, the chain from its reached entry marks the records and gives every segment its owner.

A record whose payload holds the magic has several segments; only those are collected, a record at a time, to be joined.

Cases: null html is an empty payload; a null url has no target header, line ends in urls are percent-encoded; a page without
page_id is always a response and nothing refers to it; repeated rows are records each, all of the largest page_id being
responses; html may hold whole records, of either version; a file of no bytes has no records; a file whose chain does not end at its end (cut or
damaged) raises an error on reading unless `strict` is off, which gives the records before the damage. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

MAGIC = b"\nWARC/1."
SKIP = len(MAGIC) - 1  # from a record's offset to its segment's
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records_of(pages: DataFrame, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record: the text of each page's record, without its end."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"))
    # one row for each digest that several page_ids share; written, so that a hot digest's pages can be split
    groups = stash(groups.where("low < top").select(F.col("sha").alias("of_sha"), "top"))
    # a bitmap of those digests, of at most 2^20 rows: pages outside of it are written where they are read
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << 26) - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))
    cells = stash(groups.groupBy(F.shiftright(place("of_sha"), 6).alias("cell")).agg(F.bit_or(bit("of_sha")).alias("bits")))
    rows = rows.join(F.broadcast(cells), F.shiftright(place("sha"), 6) == F.col("cell"), "left").withColumn("shared", F.coalesce(F.col("bits").bitwiseAND(bit("sha")) != 0, F.lit(False)))
    joined = rows.where("shared").hint("merge").join(groups.hint("merge"), F.col("sha") == F.col("of_sha"), "left")
    names = ["page_id", "url", "payload", "sha", "top"]
    rows = rows.where("not shared").withColumn("top", F.lit(None).cast("long")).select(names).unionByName(joined.select(names))
    again = F.coalesce(F.col("page_id") < F.col("top"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn("page_id")),
        _header("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        _header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(again, urn("top"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_warc(pages: DataFrame, path: str, **how) -> None:
    """Write a record for each page into uncompressed archives in the folder path."""
    records_of(pages, **how).write.option("lineSep", "\r\n\r\n").text(path)


def parse(segment: bytes, first: bool) -> tuple | None:
    """(head, length, type, id, uri, refers, digest) of the record that a segment begins, or None; head: from the record's
    offset to its block. A first segment holds its magic itself."""
    if first:
        if not segment.startswith(MAGIC[1:]):
            return None
        segment = segment[SKIP:]
    if segment[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = segment.find(b"\r\n\r\n")
    if end < 0:  # the block begins with the magic, whose line end closes the header
        if not segment.endswith(b"\r\n\r"):
            return None
        end = len(segment) - 3
    fields = {}
    for line in segment[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length, kind = fields.get(b"content-length", ""), fields.get(b"warc-type")
    if kind is None or not (length.isascii() and length.isdigit()) or len(length) > 18:
        return None
    return SKIP + end + 4, int(length), kind, fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"), fields.get(b"warc-refers-to"), fields.get(b"warc-payload-digest")


_SEGMENT = "file string, block long, file_size long, at long, size long, head long, length long, type string, record_id string, uri string, refers_to string, digest string, payload_bytes long, payload_sha1 string"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return found.select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", F.col("value").cast("binary").alias("value"))


def _placed(batches):
    """(file, block, file size, offset in the split's own bytes, segment): a task reads the segments of a split in order."""
    here, at = None, 0
    for batch in batches:
        for file, block, size, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (file, block) != here:
                here, at = (file, block), 0
            yield file, block, size, at, value
            at += len(value) + len(MAGIC)


def _batches(rows, schema: pa.Schema, most: int, width=lambda r: 0):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += width(r)
        if len(held) >= most or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _inside(block: bytes) -> int:
    """Where the payload begins in a block: after an HTTP head, if there is one."""
    return block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else 0


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Every segment with its absolute offset `start`, and the fields of the record that it may begin."""
    arrow = _arrow(_SEGMENT)

    def run(batches):
        def rows():
            for file, block, size, at, value in _placed(batches):
                first = block == 0 and at == 0
                found = parse(value, first) or (None,) * 7
                head, length = found[:2]
                body = (None, None)
                if head is not None:
                    a = head - (0 if first else SKIP)
                    if a + length <= len(value):  # else the magic is in the payload, or the header is false
                        content = value[a : a + length]
                        content = content[_inside(content) :]
                        body = len(content), hashlib.sha1(content).hexdigest()
                yield (file, block, size, at, len(value), *found, *body)

        yield from _batches(rows(), arrow, 4096)

    cut = stash(_scan(spark, path).mapInArrow(run, _SEGMENT))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes")).select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    cut = cut.hint("merge").join(base.hint("merge"), ["file", "block"])
    pos = F.when((F.col("block") == 0) & (F.col("at") == 0), 0).otherwise(F.col("base") + F.col("at") - SKIP)
    return cut.withColumn("start", F.col("base") + F.col("at")).withColumn("pos", F.when(F.col("head").isNotNull(), pos)).withColumn("next", F.col("pos") + F.col("head") + F.col("length") + 4)


def _exits(t: pa.Table) -> pa.Table:
    """The first offset outside of the split that each candidate's chain comes to."""
    t = t.sort_by([("pos", "descending")])
    out, exits = {}, []
    for pos, after in zip(t["pos"].to_pylist(), t["next"].to_pylist()):
        out[pos] = out.get(after, after)
        exits.append(out[pos])
    return pa.table({"file": t["file"], "pos": t["pos"], "exit": pa.array(exits, pa.int64())})


def _owners(t: pa.Table) -> pa.Table:
    """The record that each segment of a split belongs to: null before the split's first record."""
    t = t.sort_by([("at", "ascending")])
    due, owner, owners = set(), None, []
    for pos, after, entry in zip(t["pos"].to_pylist(), t["next"].to_pylist(), t["entry"].to_pylist()):
        if pos is not None and (entry or pos in due):
            due, owner = {after}, pos
        owners.append(owner)
    return pa.table({"file": t["file"], "block": t["block"], "at": t["at"], "owner": pa.array(owners, pa.int64())})


def _reached(edges: DataFrame) -> DataFrame:
    """(file, pos) of the split entries that the chain from offset 0 comes to, by pointer jumping. edges: file, pos, exit."""
    ends = edges.select("file", F.col("exit").alias("pos")).unionByName(edges.select("file", F.lit(0).cast("long").alias("pos"))).distinct()
    jump = stash(edges.hint("merge").join(ends.hint("merge"), ["file", "pos"], "left_semi"))
    nodes = jump.select("file", "pos")
    reached, count = stash(nodes.where("pos = 0")), -1
    while count != (now := reached.count()):
        count = now
        landed = jump.hint("merge").join(reached.hint("merge"), ["file", "pos"]).select("file", F.col("exit").alias("pos"))
        landed = landed.hint("merge").join(nodes.hint("merge"), ["file", "pos"], "left_semi")
        reached = stash(reached.unionByName(landed).distinct())
        onward = jump.select("file", F.col("pos").alias("exit"), F.col("exit").alias("far"))
        jump = stash(jump.hint("merge").join(onward.hint("merge"), ["file", "exit"]).select("file", "pos", F.col("far").alias("exit")))
    return reached


def _owned(spark: SparkSession, path: str) -> DataFrame:
    """Every segment with the offset of the record that it belongs to; a record's first segment has owner = pos."""
    cut = stash(_segments(spark, path))
    edges = cut.where("pos is not null").select("file", "block", "pos", "next").groupBy("file", "block").applyInArrow(_exits, "file string, pos long, exit long")
    entry = _reached(stash(edges)).withColumn("entry", F.lit(True))
    marked = cut.select("file", "block", "at", "pos", "next").hint("merge").join(entry.hint("merge"), ["file", "pos"], "left")
    owned = stash(marked.select("file", "block", "at", "pos", "next", F.coalesce("entry", F.lit(False)).alias("entry")).groupBy("file", "block").applyInArrow(_owners, "file string, block long, at long, owner long"))
    # a split's first segments may belong to the last record of a split before it
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = owned.groupBy("file", "block").agg(F.max("owner").alias("owner")).select("file", "block", F.max("owner").over(before).alias("carried"))
    cut = cut.hint("merge").join(owned.hint("merge"), ["file", "block", "at"]).hint("merge").join(last.hint("merge"), ["file", "block"])
    return stash(cut.withColumn("owner", F.coalesce("owner", "carried")).drop("carried"))


def _joined(spark: SparkSession, path: str, segments: DataFrame) -> DataFrame:
    """file, pos, payload of the records whose segments are given (file, block, at, owner): read again and put together."""
    arrow = _arrow("file string, block long, at long, value binary")

    def run(batches):
        yield from _batches(((f, b, at, v) for f, b, _, at, v in _placed(batches)), arrow, 4096, lambda r: len(r[3]))

    values = _scan(spark, path).mapInArrow(run, "file string, block long, at long, value binary")
    parts = values.hint("merge").join(segments.select("file", "block", "at", "owner", "head", "length", F.col("owner").eqNullSafe(F.col("pos")).alias("begins"), "start").hint("merge"), ["file", "block", "at"])
    whole = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", F.col("value").cast("string").alias("v")))).alias("vs"), F.max(F.when(F.col("begins"), F.struct("head", "length", "start"))).alias("h"))
    # the first segment of a file holds its magic, others stand after it
    skip = F.when(F.col("h.start") == 0, F.col("h.head")).otherwise(F.col("h.head") - SKIP)
    text = F.array_join(F.transform("vs", lambda x: x["v"]), MAGIC.decode()).cast("binary")
    block = F.substring(text, (skip + 1).cast("int"), F.col("h.length").cast("int"))
    whole = whole.select("file", F.col("owner").alias("pos"), block.alias("block"))
    http = F.startswith(F.col("block"), F.lit(b"HTTP/")) & F.contains(F.col("block"), F.lit(b"\r\n\r\n"))
    after = F.octet_length(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)) + 5
    return whole.select("file", "pos", F.when(http, F.substring("block", after, F.octet_length("block"))).otherwise(F.col("block")).alias("payload"))


def read_warc(spark: SparkSession, path: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """The records of the archives in path: file, pos, type, record_id, uri, refers_to, digest (as stated), payload_bytes and
    payload_sha1 (as found; null if the file ends before the record does), with payloads also payload (binary)."""
    owned = _owned(spark, path)
    mine = owned.where("owner is not null")
    found = mine.where("pos = owner").select("file", "pos", "next", "file_size", "type", "record_id", "uri", "refers_to", "digest", "payload_bytes", "payload_sha1")
    if strict:
        sizes = owned.groupBy("file").agg(F.max("file_size").alias("size")).join(found.groupBy("file").agg(F.max("next").alias("end")), "file", "left")
        broken = sizes.where("end is null or end <> size").first()
        if broken:
            raise ValueError(f"the records of {broken['file']} end at {broken['end']} of {broken['size']} bytes")
    parted = found.where("payload_sha1 is null and next <= file_size").select("file", F.col("pos").alias("owner"))
    if payloads:
        texts = _joined(spark, path, mine)
    elif parted.isEmpty():
        return found.drop("next", "file_size")
    else:
        texts = _joined(spark, path, mine.hint("merge").join(parted.hint("merge"), ["file", "owner"], "left_semi"))
    kept = ["payload"] if payloads else []
    texts = stash(texts.select("file", "pos", *kept, F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha")))
    out = found.hint("merge").join(texts.hint("merge"), ["file", "pos"], "left")
    complete = F.col("next") <= F.col("file_size")
    out = out.withColumn("payload_bytes", F.coalesce("payload_bytes", F.when(complete, F.col("n")))).withColumn("payload_sha1", F.coalesce("payload_sha1", F.when(complete, F.col("sha"))))
    return out.drop("next", "file_size", "n", "sha")


def round_trip(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write pages as archives in path, read these and resolve the revisits: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write_warc(pages, path, least=least)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    found = stash(read_warc(pages.sparkSession, path).select(number("record_id").alias("page_id"), "type", number("refers_to").alias("refers_to"), F.substring_index("digest", ":", -1).alias("stated"), "payload_bytes", "payload_sha1"))
    plain = found.where("type = 'response'").select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    source = stash(found.where("type = 'response'").groupBy(F.col("page_id").alias("source"), F.col("payload_sha1").alias("payload_digest")).agg(F.max("payload_bytes").alias("payload_bytes")))
    again = found.where("type = 'revisit'").select("page_id", "refers_to", "stated")
    again = again.hint("merge").join(source.hint("merge"), (F.col("refers_to") == F.col("source")) & (F.col("stated") == F.col("payload_digest")))
    return plain.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")


OP12_SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top,
        coalesce(octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY coalesce(html, '')), false) AS again FROM pages)
"""


def brute_force(data: bytes) -> list[tuple[int, str, bytes]]:
    """(offset, type, payload) of an archive's records, one after the other, for tests."""
    at, out = 0, []
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in data[at:stop].split(b"\r\n")[1:])
        block = data[stop + 4 : stop + 4 + int(fields[b"Content-Length"])]
        out.append((at, fields[b"WARC-Type"].decode(), block[_inside(block) :]))
        at = stop + 8 + len(block)
    return out
