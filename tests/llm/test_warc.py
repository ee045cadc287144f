import hashlib
import os

from visitgrid.llm import warc as W
from visitgrid.plans.ordered import checkpoint_dir

SCHEMA = "page_id long, url string, html string, offset string, archive string, n int"
LONG = "<p>" + "ä" * 80 + "</p>"


def pages(spark):
    rows = [(3, "http://a/1", LONG), (1, "http://a/2", LONG), (2, None, LONG), (4, "u\r\nX: y", None), (5, "u", ""),
            (6, "u", "short"), (7, "u", "short"), (8, "http://b", "z" * 300_000), (9, "u", "WARC/1.1\r\n\r\n" + LONG),
            (1, "http://a/2", LONG), (None, "v", LONG)]
    return spark.createDataFrame([(*r, "o", "a", 1) for r in rows], SCHEMA)


def expected(rows):
    first, out = {}, []
    for i, t in rows:
        if i is not None and len(t) >= 100:
            first[t] = min(first.get(t, i), i)
    for i, t in rows:
        later = len(t) >= 100 and t in first and first[t] != i
        out.append((i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if later else "response", first[t] if later else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = pages(spark)
    got = sorted((tuple(r) for r in W.round_trip(df).collect()), key=str)
    assert got == expected([(r["page_id"], (r["html"] or "").encode()) for r in df.collect()])


def test_index_and_selected_reads(spark):
    folder = f"{checkpoint_dir(spark)}/warc-test-{os.getpid()}"
    index = W.write_archives(pages(spark), folder, archive_bytes=1000)
    rows = index.collect()
    assert {c for c in index.columns} >= {"archive", "offset", "length", "url", "digest"}
    for r in rows:
        with open(f"{folder.removeprefix('file://')}/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            data = f.read(r["length"])
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and r["digest"].encode() in data
    some = W.read_records(index.where("page_id in (2, 8)"), folder, gap=10, read_bytes=50)
    assert {r["page_id"] for r in some.collect()} == {2, 8}


def test_damage_is_found():
    data = W.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), "response", None)
    assert W.parse(data)[1] == 200
    try:
        W.parse(data.replace(b"xxx", b"yyy"))
    except ValueError:
        return
    raise AssertionError("damage not found")


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
