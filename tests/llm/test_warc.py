"""Archives against a sequential reader, with magic everywhere and splits of a few bytes."""

import glob
import hashlib
import random
import uuid

import pytest

from trajspark.llm import warc

MAGIC = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nabc\r\n\r\n"
BIG = "é" * 600


def pages():
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", rng.choice(["<p>", "x\r\n", "\n", "é", "WARC/1.1\r\n", "\r\n\r\nWARC/1.0\r\n", "\nWARC/1."]) * rng.choice([0, 1, 3, 40, 700])) for i in range(40)]
    rows += [(100, None, None), (101, "http://a\r\nb", ""), (102, "u", "WARC/1.1\r\n" + MAGIC), (103, "u", MAGIC), (104, "u", MAGIC * 30 + "\n"), (105, "x WARC/1.1", "WARC/1.1")]
    # a whole record as payload, and one whose false length points at a true boundary's neighbourhood
    rows += [(106, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (107, "u", "y" * 3_000_000 + MAGIC)]
    rows += [(200 + i, "u", BIG) for i in range(9)] + [(208, "again", BIG), (None, "u", BIG), (None, None, None), (300, "u", "short"), (301, "u", "short"), (107, "u", "y" * 3_000_000 + MAGIC)]
    return rows


def expected(rows, least=1000):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= least and i < top[h or ""]
        yield i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, top int")


@pytest.fixture(params=["1m", "4000"])
def splits(spark, request):
    """Whole files, or splits of 4000 bytes: many lie inside a payload or a magic."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000000" if request.param == "1m" else "100")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip(spark, tmp_path, splits):
    rows = pages() if splits == "1m" else [r for r in pages() if r[0] != 107]
    path = str(tmp_path / uuid.uuid4().hex)
    assert ordered(warc.round_trip(frame(spark, rows), path).collect()) == ordered(expected(rows))


def test_reader_equals_sequential_reader(spark, tmp_path, splits):
    rows = [r for r in pages() if r[0] not in (107,)]
    path = str(tmp_path / uuid.uuid4().hex)
    warc.write_warc(frame(spark, rows).coalesce(1), path)
    want = [(hashlib.sha1(p).hexdigest(), at, k, p) for f in glob.glob(f"{path}/part-*") for at, k, p in warc.brute_force(open(f, "rb").read())]
    got = warc.read_warc(spark, path, payloads=True).collect()
    assert sorted((r.payload_sha1, r.pos, r.type, bytes(r.payload)) for r in got) == sorted(want)
    assert len(got) == len(rows) and all(r.digest == f"sha1:{r.payload_sha1}" for r in got if r.type == "response")


def test_damage(spark, tmp_path):
    path = tmp_path / "warc"
    warc.write_warc(frame(spark, [(i, "u", "abc" * i) for i in range(9)]).coalesce(1), str(path))
    (file,) = glob.glob(f"{path}/part-*")
    data = open(file, "rb").read()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(data[:-20])
    with pytest.raises(ValueError, match="end at"):
        warc.read_warc(spark, str(cut))
    got = warc.read_warc(spark, str(cut), strict=False).orderBy("pos").collect()
    assert len(got) == 9 and [r.payload_sha1 is None for r in got] == [False] * 8 + [True]
    (cut / "a.warc").write_bytes(b"\n" + data)
    assert warc.read_warc(spark, str(cut), strict=False).count() == 0


def test_empty(spark, tmp_path):
    assert warc.round_trip(frame(spark, []), str(tmp_path / "none")).count() == 0
