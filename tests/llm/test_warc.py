import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import warc


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "warc")


def _pages(spark, rows, parts=3):
    """With extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, 1, "d", None, 2) for r in rows],
                                 "page_id long, url string, html string, salt int, digest string, owner long, `place` int"
                                 ).repartition(parts)


ROWS = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 20) for i in range(40)] + [
    (100, "http://h/s", "short"), (101, "http://h/s", "short"), (102, None, None), (103, "http://h/\r\nx: y", ""),
    (None, "http://h/n", "<p>none</p>" * 20), (104, "http://h/n", "<p>none</p>" * 20),
    (None, "http://h/m", "<i>only</i>" * 20), (None, "http://h/m", "<i>only</i>" * 20),
    (105, "http://h/r", "<b>r</b>" * 30), (105, "http://h/r", "<b>r</b>" * 30),
    (1 << 40, "http://h/long", "é\r\n\r\nWARC/1.1 日 🎉" * 200_000)]


def _brute(rows):
    groups = defaultdict(list)
    for page, url, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for n, page in enumerate(ids):
            again = n > 0 and len(payload) >= 100
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response",
                        ids[0] if again else None))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("many", [1000, 2])
def test_round_trip(spark, folder, monkeypatch, many):
    monkeypatch.setattr(warc, "MANY", many)
    assert _got(warc.warc_digests(_pages(spark, ROWS), folder)) == _brute(ROWS)


def test_payloads_of_selected_records(spark, folder):
    index = warc.write_archives(_pages(spark, ROWS), folder, archive_bytes=2000)
    assert index.select("file").distinct().count() > 2
    got = warc.read_records(index.where("record_type = 'response' AND page_id % 2 = 1")).collect()
    want = {p: (h or "").encode() for p, _, h in ROWS if p is not None}
    assert {r.page_id for r in got} == {p for p, _, _, k, _ in _brute(ROWS) if k == "response" and p and p % 2 == 1}
    assert all(bytes(r.payload) == want[r.page_id] for r in got)
    assert {r.url for r in got if r.page_id == 103} == {"http://h/%0D%0Ax: y"}


def test_archives_are_plain_gzip_members(spark, folder):
    import glob
    import gzip
    warc.write_archives(_pages(spark, ROWS), folder)
    whole = [gzip.open(f).read() for f in glob.glob(f"{folder}/archives/*.warc.gz")]
    assert all(w.startswith(b"WARC/1.1\r\n") for w in whole)
    assert sum(w.count(b"\r\nWARC-Record-ID: ") for w in whole) == len(ROWS)


def test_hot_payload_is_spread(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "MANY", 50)
    rows = [(i, f"u{i}", "<p>hot</p>" * 30 if i % 3 else f"<p>{i}</p>" * 30) for i in range(3000)]
    dealt = warc.typed_rows(_pages(spark, rows, 20), archive_bytes=20_000)
    sizes = [r["count"] for r in dealt.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert max(sizes) < 4 * np.mean(sizes)
    assert _got(warc.warc_digests(_pages(spark, rows), folder)) == _brute(rows)


def test_ranges_join_neighbours():
    offset, length = np.array([0, 10, 20, 10**6, 0]), np.array([10, 10, 5, 7, 9])
    assert warc.ranges(offset, length, ["a"] * 4 + ["b"]) == [(0, 3), (3, 4), (4, 5)]


def test_damaged_records_are_refused():
    good = warc.record(1, "u", "response", None, b"payload", 7, hashlib.sha256(b"payload").hexdigest(), "d")
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"paYload"), b"X" + good):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_empty_table(spark, folder):
    assert warc.warc_digests(_pages(spark, ROWS[:1]).where("false"), folder).count() == 0
