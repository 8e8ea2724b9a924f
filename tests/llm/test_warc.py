import random

from pyspark.sql import functions as F

from fleetframe.llm.warc import (OP4_SQL, base32_sha1, gzip_member, op4_warc, read_warc, render_record, salvage,
                                 write_warc)
from tests.conftest import SF_SMALL
from tests.harness import digest, duck


def record(i, body):
    return render_record(str(i), "http://x/", body, base32_sha1(body), None, "2000-01-01T00:00:00Z")


def recovered(archive):
    return [f["block"].partition(b"\r\n\r\n")[2] for _, _, f in salvage(archive) if isinstance(f, dict)]


def gaps(archive):
    return [(s, e) for s, e, f in salvage(archive) if isinstance(f, str)]


def test_headers_of_any_length(spark, tmp_out):
    url = "http://x/" + "é?" * (1 << 20)
    for wrap in (gzip_member, lambda r: r):
        parts = [wrap(render_record(str(i), u, b"p", base32_sha1(b"p"), None, "2000-01-01T00:00:00Z"))
                 for i, u in enumerate((url, "http://x/", url))]
        assert recovered(b"".join(parts)) == [b"p"] * 3 and gaps(b"".join(parts)) == []
        junk = parts[0][:40] + b"\r\nno header" * (1 << 17)  # the headers never end
        assert recovered(junk + parts[1]) == [b"p"] and gaps(junk + parts[1]) == [(0, len(junk))]
    df = spark.createDataFrame([(1, url, "one"), (2, "http://y/", "two")], "page_id long, url string, html string")
    write_warc(df, tmp_out + "/a", "page_id", "url", "html")
    back = read_warc(spark, tmp_out + "/a").collect()
    assert sorted((r.gap, bytes(r.payload)) for r in back) == [(False, b"one"), (False, b"two")]


def test_salvage_gzip_and_plain():
    rng = random.Random(3)
    bodies = [bytes(rng.choices(b"abc WARC/1.1\r\n", k=rng.randrange(0, 4000))) for _ in range(40)]
    for wrap in (gzip_member, lambda r: r):
        parts = [wrap(record(i, b)) for i, b in enumerate(bodies)]
        assert recovered(b"".join(parts)) == bodies and gaps(b"".join(parts)) == []
        starts = [sum(map(len, parts[:i])) for i in range(41)]
        for _ in range(25):
            data, bad = bytearray(b"".join(parts)), sorted(rng.sample(range(40), 3))
            for i in bad:  # in a plain record only the block is under a digest
                first = 12 if wrap is gzip_member else parts[i].find(b"\r\n\r\n") + 4
                data[rng.randrange(starts[i] + first, starts[i + 1])] ^= 0x55
            good = [b for i, b in enumerate(bodies) if i not in bad]
            got = recovered(bytes(data))
            assert [b for b in got if b in good] == [b for b in got] and len(got) >= 37
            quarantined = sum(e - s for s, e in gaps(bytes(data)))
            assert quarantined <= sum(len(parts[i]) for i in bad)
            if len(got) == 37:
                assert got == good and quarantined == sum(len(parts[i]) for i in bad)


def test_garbage_truncation_and_mixture():
    a, b, c = gzip_member(record(1, b"one")), record(2, b"two"), gzip_member(record(3, b"three"))
    data = b"junk\x1f\x8b\x08junk" + a + b"\x00\x01" + b + b"WARC/1.0\r\nbroken\r\n\r\n" + c + c[:-9]
    assert recovered(data) == [b"one", b"two", b"three"]
    junk, tail = 11, len(c) - 9
    assert gaps(data) == [(0, junk), (junk + len(a), junk + len(a) + 2),
                          (junk + len(a) + 2 + len(b), len(data) - tail - len(c)), (len(data) - tail, len(data))]
    assert list(salvage(b"")) == []


def test_large_record_ends_in_zero_byte():
    body = bytes(random.Random(1).randbytes(1 << 10)) * (17 << 10)
    m = gzip_member(record(1, body), 1)
    assert m[-1] == 0 and recovered(m + gzip_member(record(2, b""))) == [body, b""]


def test_round_trip_with_ties_nulls_and_damage(spark, tmp_path):
    rows = [(1, "u\r\nv", "x"), (2, None, "x"), (3, "u", None), (None, "u", "x"), (4, "u", ""), (5, "ü", "é" * 300000),
            (2, "again", "x"), (6, "u", "alone")]
    df = spark.createDataFrame(rows, "k long, u string, h string")
    path = str(tmp_path / "w")
    write_warc(df.repartition(3), path, "k", "u", "h", archive_bytes=300)
    got = read_warc(spark, path).filter("not gap")
    types = sorted((r.record_id.split(":")[-1], r.record_type, r.refers_to and r.refers_to.split(":")[-1])
                   for r in got.collect())
    assert types == sorted([("1", "revisit", "2"), ("2", "response", None), ("2", "response", None),
                            ("null", "revisit", "2"), ("3", "revisit", "4"), ("4", "response", None),
                            ("5", "response", None), ("6", "response", None)])
    assert {bytes(r.payload).decode() for r in got.filter("record_type = 'response'").collect()} == {
        "x", "", "é" * 300000, "alone"}
    hit = next(p for p in (tmp_path / "w").rglob("*.txt") if len(p.read_bytes()) > 300)
    hit.write_bytes(b"??" + hit.read_bytes()[:-20])
    for crc in hit.parent.glob(".*.crc"):
        crc.unlink()
    after = read_warc(spark, path)
    assert after.filter("gap").count() >= 1 and after.filter("not gap").count() < 8
    keep = str(tmp_path / "m")
    write_warc(df, keep, "k", "u", "h", min_bytes=2)
    assert read_warc(spark, keep).filter("record_type = 'revisit'").count() == 0
    empty = str(tmp_path / "e")
    write_warc(df.limit(0), empty, "k", "u", "h")
    assert read_warc(spark, empty).count() == 0


def test_query_matches_sql(spark):
    got = op4_warc(spark, SF_SMALL)
    cols = sorted(got.columns)
    rel = duck(SF_SMALL).sql(f"SELECT {', '.join(cols)} FROM ({OP4_SQL})")
    assert digest([tuple(r[c] for c in cols) for r in got.collect()])[0] == digest(rel.fetchall())[0]
    assert got.filter(F.col("record_type") == "response").count() > 0
