import gzip
import io

import pytest
from pyarrow import fs as pafs
from soundgrid.llm import warc
from soundgrid.llm.common import new_path

PAGES = [(4, "http://a", "same"), (2, "http://b\nc", "same"), (9, None, None), (8, "u", ""), (1, "x", "é\r\n\r\nWARC/1.1\r\n" * 50), (7, "y", "z" * 300_000), (2, "http://b", "same"), (None, "n", "same"), (None, "m", "alone")]


def want(rows, least):
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        first = min(ids, default=None)
        rev = len(b) >= least and p != first
        out.append((p, len(b), warc.digest(b), "revisit" if rev else "response", first if rev else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, "c") for r in PAGES], "page_id long, url string, html string, key string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(df, least).collect()), key=str) == want(PAGES, least)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_members_can_be_read_alone_and_index_has_offsets(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_path(spark, "warc-test")
    index = warc.normalise(warc.write(df, f"{folder}/a", archive_bytes=1000), f"{folder}/b")
    for r in index.collect():
        fs, path = pafs.FileSystem.from_uri(r.archive)
        with fs.open_input_file(path) as f:
            f.seek(r.offset)
            raw = gzip.decompress(f.read(r.length))
        assert raw.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {r.record_id}".encode() in raw
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path.rsplit("/", 1)[0]))]
    assert len([n for n in names if n.endswith(".cdxj")]) == len([n for n in names if n.endswith(".warc.gz")]) > 1
    assert not [n for n in names if n.endswith(".part")]


def test_damaged_archives_are_told(spark):
    whole = gzip.compress(warc.record(1, "u", b"abc", 1, False)) + gzip.compress(warc.record(2, "u", b"abc", 1, True))
    assert len(list(warc.records(warc.inflated(io.BytesIO(whole), 7)))) == 2
    for bad in (whole[:-9], gzip.compress(warc.record(1, "u", b"abc", 1, False)[:-1])):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(io.BytesIO(bad))))


def test_pieces_are_bounded():
    import gzip
    import io

    from soundgrid.llm import warc

    data = b"a" * 5_000_000 + b"tail" * 10
    for raw in (gzip.compress(data), gzip.compress(data[:7]) + gzip.compress(b"") + gzip.compress(data[7:])):
        pieces = list(warc.inflated(io.BytesIO(raw), 1000))
        assert b"".join(pieces) == data and max(map(len, pieces)) <= 1000
