import gzip
import hashlib
import random

import pytest
from gleaner.llm import warc_merge as wm
from gleaner.llm.warc_merge import LoserTree, capture_histories, merge_runs, parse_archive, read_runs, write_archives
from pyspark.sql import functions as F


def test_loser_tree_merges():
    rng = random.Random(0)
    for _ in range(300):
        lists = [sorted((rng.randrange(15), k) for _ in range(rng.randrange(7))) for k in range(rng.randrange(9))]
        assert [*LoserTree(lists, key=lambda x: x)] == sorted(x for own in lists for x in own)


LONG = "<p>" + "x" * 200 + "</p>"
ROWS = [
    (5, "http://www.Example.com/a?b=1#frag", LONG), (2, "https://example.com/a", LONG), (9, "http://sub.example.com:80/", LONG), (1, "http://b.org/", "short"), (3, "http://b.org/", "short"),
    (4, None, None), (6, "http://b.org/\r\nX: y z%41", "body\r\n\r\nWARC/1.1\r\n\r\n" * 20), (7, "http://é.fr/ü", "ünïcode " * 30), (None, "http://none.org/", LONG), (8, "http://b.org/long", "word " * 400_000), (10, "http://b.org/", ""),
    (2, "https://example.com/a", LONG), (2**62, None, "far away"), (-5, "x", None),
]


def test_round_trip_and_revisits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).repartition(3)
    got = capture_histories(pages, str(tmp_path / "a")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        body = next(h for p, u, h in ROWS if (p, u) == (r.page_id, r.url)) or ""
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == hashlib.sha256(body.encode()).hexdigest()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([(1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (6, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 2), (10, "response", None), (None, "revisit", 2), (2**62, "response", None), (-5, "response", None)], key=str)
    keys = [(r.url_key.encode(), r.capture_time) for r in got]
    assert keys == sorted(keys)
    assert {r.url_key for r in got if r.page_id in (2, 5)} == {"com,example)/a", "com,example)/a?b=1"}


def test_offsets_point_at_records(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    write_archives(pages.coalesce(1), str(tmp_path / "b"))
    (file,) = (tmp_path / "b").glob("part-*")
    raw = gzip.decompress(file.read_bytes())
    assert [*parse_archive(raw, "x")] == [*parse_archive(file.read_bytes(), "x")]
    members = b"".join(gzip.compress(raw[e[9] : e[9] + e[10]]) for e in parse_archive(raw, "x"))
    assert [*parse_archive(members, "x")] == [*parse_archive(raw, "x")]
    for broken in (raw[:-3], raw.replace(b"ynic", b"xnic").replace(b"<p>x", b"<p>y")):
        with pytest.raises(ValueError, match="archive|damaged"):
            list(parse_archive(broken, "x"))
    for entry in parse_archive(raw, file.name):
        assert raw[entry[9] :].startswith(b"WARC/1.1\r\n") and raw[: entry[9] + entry[10]].endswith(b"\r\n\r\n")


def test_archives_split_by_size_and_runs_beyond_the_buffer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wm, "_PIECE", 300)  # smaller than a record: streams are read in many pieces
    rows = [(k, f"http://h{k % 7}.org/{k % 90}", f"body {k} " * (1 + k % 40)) for k in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    write_archives(pages, str(tmp_path / "c"), archive_bytes=60_000)
    files = [*(tmp_path / "c").glob("part-*")]
    sizes = [len(gzip.decompress(f.read_bytes())) for f in files]
    assert len(files) > 10 and max(sizes) < 120_000
    index = read_runs(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "c")))
    merged = merge_runs(index, range_entries=100)
    assert merged.rdd.getNumPartitions() >= 9
    got = [(r.url_key, r.capture_time, r.page_id) for r in merged.collect()]
    assert got == sorted(got) and len(got) == 900
    assert len({r.archive for r in merged.collect()}) == len(files)


def test_control_characters_in_urls(spark):
    url = "http://a.org/" + "".join(map(chr, [1, 9, 10, 13, 27, 31, 127])) + "%41 z"
    got = capture_histories(spark.createDataFrame([(1, url, "x")], "page_id long, url string, html string")).first()
    assert got.url == url


def test_empty_table(spark):
    assert capture_histories(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
