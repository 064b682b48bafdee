import base64
import hashlib
import io
from pathlib import Path

import pytest
import zstandard

from tessera.llm import warc_zstd as wz
from tessera.llm.common import shared_path, table

SF = "/root/testdata/sf0.01"


def expected(rows, min_bytes=0):
    out, last = [], {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        to = last.get(html or "")
        visit = page is not None and len(data) >= min_bytes and page != to
        out.append((page, len(data), digest, "revisit" if visit else "response", to if visit else None))
    return sorted(out, key=str)


def test_round_trip_of_the_table(spark, con):
    rows = con.execute(f"SELECT page_id, url, html FROM read_parquet('{SF}/pages.parquet')").fetchall()
    got = wz.report(table(spark, SF, "pages"), archive_bytes=1 << 20, sample_bytes=1 << 18)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def rows_with_copies():
    return ([(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 40) for i in range(50)] + [(60, None, None), (61, "u\r\nx", ""),
            (62, "v", "é" * 300_000), (63, "P*M", wz._SKIP * 9), (None, "w", "<p>1</p>" * 40), (49, "again", "<p>0</p>" * 40),
            (64, "x", "no copy")])


@pytest.mark.parametrize("min_bytes", [0, 400])
def test_small_cases(spark, min_bytes):
    rows = rows_with_copies()
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "page_id long, url string, html string, digest string, keeper int")
    got = wz.report(pages, min_bytes=min_bytes, archive_bytes=200_000)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, min_bytes)
    assert wz.report(pages.limit(0)).count() == 0


def test_files_are_plain_zstandard_with_a_leading_dictionary(spark):
    path = shared_path(spark, "warc-test")
    wz.write(table(spark, SF, "pages"), path, archive_bytes=1 << 18)
    files = sorted(Path(path).glob("part-*"))
    assert len(files) > 1
    for f in files:
        data = f.read_bytes()
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdCompressionDict(data[8:8 + size])
        with zstandard.ZstdDecompressor(dict_data=d).stream_reader(io.BytesIO(data), read_across_frames=True) as r:
            assert r.read() == b"".join(wz.records_of(data))
        one = next(wz.records_of(data))
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        assert wz.parse(one)[0]["warc-type"] in ("response", "revisit")
    with pytest.raises(ValueError):
        list(wz.records_of(files[0].read_bytes()[:-20]))
