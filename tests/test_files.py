"""Pool files of every kind, and digests of long lists."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.digest import ordered_digests
from barloom.operators.identity import batch_identity
from barloom.operators.opinions import source_fingerprint
from barloom.sources.ingest import pool_rows, read_pool_files


def test_pool_files_with_cr_and_unmarked_utf16(spark, tmp_path):
    (tmp_path / "cr.xls").write_bytes("代码\t名称\r600001\t甲\r600002\t乙\r".encode("gb18030"))
    (tmp_path / "le.xls").write_bytes("code,name\n600003,丙\n".encode("utf-16-le") + b"\0")
    (tmp_path / "be.xls").write_bytes("code,name\r\n600004,丁\r\n".encode("utf-16-be"))
    (tmp_path / "wide.xls").write_bytes("代 码;名称\n600005;戊\n".encode("utf-16-le"))
    (tmp_path / "quoted.csv").write_bytes('"备注","代码","名称"\n"a,""b""\nc","600006","己, 庚"\n\n,,\n'.encode("utf-8-sig"))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {r.symbol: r.name for r in read_pool_files(spark, [str(tmp_path)]).collect()}
    assert got == {"600001": "甲", "600002": "乙", "600003": "丙", "600004": "丁", "600005": "戊", "600006": "己, 庚"}


def test_file_without_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n1,2\n")
    with pytest.raises(Exception, match="x.csv"):
        read_pool_files(spark, [str(tmp_path)]).collect()
    with pytest.raises(ValueError):
        pool_rows(b"\x00\x01\x02\xff" * 9)


def test_ordered_digests(spark):
    """Groups from nothing to several packs and parts, one with most rows, a null group."""
    rng = random.Random(4)
    rows = [(g, f"v{rng.random()}") for g, n in (("hot", 30000), ("b", 4096), ("c", 4097), (None, 3), ("d", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v string").repartition(6)
    got = {r.g: (r.digest, r.n) for r in ordered_digests(df, ["g"], F.col("v"), F.col("v"), "|", "<", ">").collect()}
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    assert got == {g: (hashlib.sha256(("<" + "|".join(sorted(vs)) + ">").encode()).hexdigest(), len(vs)) for g, vs in want.items()}
    assert ordered_digests(df.limit(0), ["g"], F.col("v"), F.col("v"), "|").count() == 0


def test_batch_identity_of_many_codes(spark):
    codes = [f"{i % 70000:06d}" for i in range(100000)]
    r = batch_identity(spark.createDataFrame([(c,) for c in codes], "symbol string"), "2026-01-02").first()
    assert (r.batch_id, r.n) == ("20260102_" + hashlib.sha256("\n".join(sorted(set(codes))).encode()).hexdigest()[:16], 70000)
    none = batch_identity(spark.createDataFrame([], "symbol string"), "2026-01-02").first()
    assert (none.batch_id, none.n) == ("20260102_" + hashlib.sha256(b"").hexdigest()[:16], 0)


def test_fingerprint_of_addresses_and_ids(spark):
    rows = [("d1", "u\"2", "i1"), ("d1", "", "i2"), ("d1", None, "i0"), ("d1", None, None), ("d2", None, ""), (None, "é", "x")]
    got = {r.article_day: (r.fingerprint, r.n_sources) for r in source_fingerprint(spark.createDataFrame(rows, "article_day string, url string, doc_id string")).collect()}
    sha = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False).encode()).hexdigest()
    assert got == {"d1": (sha(["i0", "i2", 'u"2']), 4), "d2": (sha([]), 1), None: (sha(["é"]), 1)}


def test_json_objects_in_answers(spark):
    from barloom.functions.scalars import json_object_text
    good = ['{"a": 1}', ' {"a": {"b": [1, {}]}}\n', '```json\n{"a": 1}\n```', '```{"a": 1}```', 'Text {"a": "}"} and more.', '{"a": 1}, done']
    bad = ['[1]', '{"a": 1}, {"b": 2}', '{"a": 1}} {', '{a', 'none', '', None, '[{"a": 1}], {"b": 2}']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in good + bad], "t string").select(json_object_text("t")).collect()]
    assert [json.loads(x) for x in got[:len(good)]] == [{"a": 1}, {"a": {"b": [1, {}]}}, {"a": 1}, {"a": 1}, {"a": "}"}, {"a": 1}]
    assert got[len(good):] == [None] * len(bad)


def test_nested_blocks_take_linear_time(spark):
    """Only the outermost of nested blocks holds their text; end tags without a beginning cost nothing."""
    import time
    from barloom.operators.pages import parsed
    deep = "<div class='content'>x" * 20000 + "</p></b>" * 20000 + "</div>" * 20000
    t = time.time()
    title, blocks, everything, _ = parsed(f"<title>a<b>c</b></title>{deep}<article>tail</article>")
    assert time.time() - t < 20
    assert title == "a c" and blocks[1:] == ["tail"] and blocks[0] == "\n".join(["x"] * 20000) and everything.count("\n") == 20002
