import hashlib

import pytest

from watttrail.llm.warc import read_archive, write_archive
from watttrail.session import new_path

LONG = "<html>" + "x" * 200
ROWS = [(5, "http://a/", LONG), (3, "http://b/\r\nX: y", LONG), (9, None, LONG), (None, "u", LONG), (1, "", None), (2, "e", ""),
        (7, "s", "short"), (8, "s", "short"), (8, "s", "short"), (10, "é", "ñ" * 90 + "\r\n\r\nWARC/1.1\r\n"), (5, "http://a/", LONG)]


def archive(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as sha")
    path = new_path(spark, "test-warc")
    write_archive(df, path)
    return path


def test_round_trip(spark):
    path = archive(spark, ROWS)
    got = read_archive(spark, path).collect()
    assert len(got) == len(ROWS)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert len(stored) == len({t or "" for _, _, t in ROWS})
    by_page = {}
    for r in got:
        by_page.setdefault(r.page, []).append(r)
        payload = bytes(r.payload)
        assert hashlib.sha256(payload).hexdigest() == r.payload_digest
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert (head + b"\r\n\r\n").decode() == r.header and r.header.startswith("WARC/1.1\r\n")
        assert block == (b"" if r.record_type == "revisit" else payload) + b"\r\n\r\n"
        assert f"Content-Length: {len(block) - 4}\r\n" in r.header
    kinds = {p: sorted((r.record_type, r.refers_to) for r in rs) for p, rs in by_page.items()}
    assert kinds["3"] == [("response", None)]
    assert kinds["5"] == [("revisit", "3")] * 2
    assert kinds["9"] == kinds[""] == [("revisit", "3")]
    assert kinds["8"] == [("response", None)] * 2 and kinds["1"] == kinds["2"] == [("response", None)]
    assert bytes(by_page["10"][0].payload).decode() == ROWS[9][2]


def test_many_records_of_one_payload(spark):
    path = archive(spark, [(i, "u", LONG) for i in range(700)])
    assert spark.read.parquet(f"{path}/payloads").first().copies == 6
    got = read_archive(spark, path).groupBy("record_type", "refers_to").count().collect()
    assert sorted(tuple(r) for r in got if r.record_type == "revisit") == [("revisit", "0", 699)]


def test_damage_is_found_and_empty_archives_read(spark):
    path = archive(spark, ROWS[:2])
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' as binary) payload", "copies").write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="payload missing or damaged"):
        read_archive(spark, f"{path}-bad").collect()
    assert read_archive(spark, archive(spark, [])).collect() == []


def test_ids_of_any_characters_and_dates(spark):
    ids = ["a:b", "x\r\nWARC-Type: revisit", "a b+c%3A", "é>", "", None]
    rows = [(i, f"u{n}", f"text {n}", f"2024-03-0{n + 1} 05:06:07") for n, i in enumerate(ids)] + [("z", "u", LONG, None), ("y:z", "u", LONG, None)]
    df = spark.createDataFrame(rows, "ID string, url string, html string, at string").selectExpr("*", "cast(at as timestamp) t", "1 as Url_", "2 as PAGE", "3 as date")
    path = new_path(spark, "test-warc")
    write_archive(df, path, id_col="ID", date_col="t")
    got = read_archive(spark, path).collect()
    assert sorted(r.page for r in got) == sorted((i or "") for i in [*ids, "z", "y:z"])
    assert {(r.page, r.record_type, r.refers_to) for r in got if r.record_type == "revisit"} == {("z", "revisit", "y:z")}
    dates = {r.url: r.header.split("WARC-Date: ")[1].split("\r\n")[0] for r in read_archive(spark, path).selectExpr("header", "regexp_extract(header, 'URI: ([^\\\\r]*)', 1) url").collect()}
    assert dates["u0"] == "2024-03-01T05:06:07Z" and dates["u"] == "1970-01-01T00:00:00Z"
    assert all(r.header.count("\r\n") == len([line for line in r.header.split("\r\n") if line]) + 1 for r in got)
