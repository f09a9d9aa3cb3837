"""Edge rows of single operators."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderspark.functions import extract as X
from tenderspark.functions import text as T
from tenderspark.operators import certs as C
from tenderspark.operators import evaluation as E
from tenderspark.operators import lifecycle as L
from tenderspark.operators import long_texts
from tenderspark.operators import pricing as P
from tenderspark.operators import segments as S
from tenderspark.sources import outcome_book as B
from tenderspark.streaming import jobs


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *((r,) if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_normalize_text(spark):
    assert values(spark, ["１２Ａｚ　Ｚ", "  a   b ", "", None], "t string", T.normalize_text(F.col("t"))) == ["12Az Z", "a b", "", ""]


def test_loose_dates(spark):
    got = values(spark, ["2025年12月", "2025年", "长期", "2O25-O1-O2", "2025/1/2", "2024年2月30日", "x", None, "20250102"], "t string", T.parse_loose_date(F.col("t")))
    d = dt.date
    assert got == [d(2025, 12, 31), d(2025, 12, 31), d(2099, 12, 31), d(2025, 1, 2), d(2025, 1, 2), None, None, None, None]
    more = values(spark, ["　长期有效", "2o24-01-05", "20245年3月1日", "2024年1月5", "2024.1-5", "2024年2月", "2024.12.31 ", "2024年13月"], "t string", T.parse_loose_date(F.col("t")))
    assert more == [d(2099, 12, 31), d(2024, 1, 5), d(2024, 3, 1), None, None, d(2024, 2, 29), d(2024, 12, 31), None]


def test_sliding_chunks(spark):
    cut = T.sliding_chunks(F.col("t"))
    full, hard = "a" * 500, "a" * 1200
    stop = "a" * 449 + "。" + "b" * 300
    got = values(spark, [None, "", "  \n", "ab", full, hard, stop], "t string", cut)
    assert got[:3] == [[], [], []] and got[3] == ["ab"] and got[4] == [full]
    assert [len(c) for c in got[5]] == [500, 500, 300] and got[5][0][-50:] == got[5][1][:50]
    assert got[6][0] == "a" * 449 + "。"
    wide = values(spark, [hard], "t string", T.sliding_chunks(F.col("t"), 500, 200))[0]
    assert len(wide[0]) + len(wide[1]) - 150 == 850  # the overlap is capped at 0.3


@pytest.mark.parametrize(("size", "overlap", "block"), [(50, 5, 60), (50, 40, 50), (20, 0, 300), (500, 50, 700)])
def test_long_texts_are_cut_as_by_one_pass(spark, size, overlap, block):
    rng = random.Random(size + block)
    texts = ["".join(rng.choices("ab 。.\n字😀", [9, 9, 3, r, r, r, 3, 1], k=n)) for r in (0, 1) for n in (0, 1, block, block + 1, 5 * block, 5 * block + size, 3001)]
    rows = [*enumerate(texts), (7, texts[4]), (7, texts[4]), (None, texts[-1]), (90, None), (91, " \n" * block)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc long, text string, key string")
    want = sorted((str(i), k, t[a:b]) for i, t in rows for k, (a, b) in enumerate(T.cut_points(t or "", size, overlap, 0.3)))
    got = long_texts.chunk_documents(docs, size, overlap, block=block).collect()
    assert sorted((str(r["doc"]), r["k"], r["chunk"]) for r in got) == want
    assert long_texts.chunk_documents(docs.limit(0), size, overlap, block=block).count() == 0


def test_suffixes_and_signals(spark):
    assert values(spark, ["2025_某项目_投标文件", "x_采购包 12", "x", None], "t string", T.strip_doc_suffix(F.col("t"))) == ["2025_某项目", "x", "x", None]
    assert values(spark, ["won", "lost", "failed", "?", None], "t string", B.derive_win_signal(F.col("t"))) == ["positive", "negative", "negative", "neutral", "neutral"]


def test_salvage_json(spark):
    got = values(spark, ['{"a":1}', '<think>{x}</think> so {"a": {"b": 2}} end', "none", None], "t string", T.salvage_json(F.col("t")))
    assert got == ['{"a":1}', '{"a": {"b": 2}}', None, None]


def test_navigation(spark):
    got = values(spark, ["服务方案 1234", "第一章 总则 12", "1.2.3 方案 123", "正文内容", "x" * 200, None], "t string", T.flag_navigation(F.col("t")))
    assert got == [True, True, True, False, False, False]


def test_outcome_book(spark, tmp_path):
    p = tmp_path / "book.csv"
    p.write_text(
        '﻿historical_tender_id,tender_file_hash,"tender_file_name ",project_name,our_bid_status,our_bid_price,submission_date,loss_root_cause_tags\n'
        '1,,a.pdf,2025_某项目,won,12.5,2025-01-02,"[""价格""]"\n,h2,,另一个,lost,x,2025/1/2,not json\nabc,,,q,won,1,20250102,\n,,,,won,1,,\n,,,第三,failed,,20250102,\n',
        encoding="utf-8",
    )
    rows = B.read_outcome_book(spark, str(p)).orderBy("project_name").collect()
    assert {r["project_name"] for r in rows} == {"2025_某项目", "另一个", "第三"}
    by = {r["project_name"]: r for r in rows}
    assert by["2025_某项目"]["our_bid_price"] == Decimal("12.50") and by["2025_某项目"]["loss_root_cause_tags"] == ["价格"]
    assert by["2025_某项目"]["tender_file_name"] == "a.pdf" and by["另一个"]["our_bid_price"] is None and by["另一个"]["loss_root_cause_tags"] == []
    assert {r["submission_date"] for r in rows} == {dt.date(2025, 1, 2)} and by["第三"]["win_signal"] == "negative"


def test_gap_buckets(spark):
    rows = [(95, 100), (94, 100), (102, 100), (103, 100), (110, 100), (111, 100), (1, 0), (1, None)]
    got = values(spark, [(Decimal(a), None if b is None else Decimal(b)) for a, b in rows], "a decimal(15,2), b decimal(15,2)", P.gap_bucket(F.col("a"), F.col("b")))
    assert got == ["winning", "underpriced", "winning", "slightly_high", "slightly_high", "overpriced", None, None]


def test_scenarios(spark):
    df = spark.createDataFrame([(1, Decimal("100000"), Decimal("150000"), None, 85), (2, Decimal("0"), Decimal("10"), None, 0)], "id long, cost decimal(15,2), budget decimal(15,2), multiplier double, relationship int")
    rows = {r["tier"]: r for r in P.price_scenarios(df).collect()}
    assert [float(rows[t]["price"]) for t in ("aggressive", "balanced", "conservative")] == [103000.0, 108000.0, 115000.0]
    assert rows["conservative"]["recommended"] and rows["conservative"]["win_probability"] >= 0.75 and len(rows) == 3


def test_breakdown_and_half_even(spark):
    df = spark.createDataFrame([(Decimal("100000"),), (Decimal("2.50"),)], "c decimal(15,2)")
    rows = df.select(*P.breakdown_cost(F.col("c"))).collect()
    assert [float(x) for x in rows[0]] == [55000, 25000, 12000, 8000] and rows[1]["food"] == Decimal("1.38") and rows[1]["labour"] == Decimal("0.62")


def test_intercepts(spark):
    rows = [(99000, 100000, 1500000), (101000, 100000, 1500000), (1600000, 1000, 1500000)]
    level = P.check_intercepts(F.col("p"), F.col("c"), F.col("b"), F.col("p"))[0]
    assert values(spark, [tuple(map(Decimal, r)) for r in rows], "p decimal(15,2), c decimal(15,2), b decimal(15,2)", level) == ["error", "ok", "over_limit"]
    assert values(spark, [(Decimal(1450000), Decimal(1500000)), (Decimal(1400000), Decimal(1500000))], "c decimal(15,2), b decimal(15,2)", P.near_limit(F.col("c"), F.col("b"))) == [True, False]


def test_win_probability(spark):
    rows = [(50, "relaxed", 100, 0), (80, "expired", 100, 0), (60, "urgent", 0, 20), (100, "relaxed", 100, 0)]
    got = values(spark, rows, "q int, l string, r int, c int", E.win_probability(F.col("q"), F.col("l"), F.col("r"), F.col("c")))
    assert got[0] == 0 and got[1] == 0 and got[2] > 0 and got[3] == 1.0


def test_time_levels(spark):
    now = dt.datetime(2025, 1, 10, 12)
    days = [-1, 0, 3, 4, 7, 8, 15, 16, -0.5]
    rows = [(now + dt.timedelta(days=x),) for x in days] + [(None,)]
    level = E.time_urgency(F.col("t"), F.lit(now))["level"]
    assert values(spark, rows, "t timestamp", level) == ["expired", "urgent", "urgent", "tight", "tight", "normal", "normal", "relaxed", "expired", "unknown"]


def test_suggest_cert(spark):
    certs = spark.createDataFrame(
        [(1, "BUSINESS-LICENSE", "营业执照", None, ["公司营业执照", "企业营业执照"], [], ["副本", "吊销"]), (2, "FOOD-BUSINESS-LICENSE", "食品经营许可证", None, ["食品流通许可证", "食品经营"], [], ["生产", "小作坊"]),
         (3, "ISO-9001-2015", "质量管理体系认证", "ISO9001", ["ISO 9001", "质量体系认证"], [], ["环境"])],
        "cert_id int, cert_code string, cert_full_name string, cert_short_name string, aliases array<string>, required_keywords array<string>, exclude_keywords array<string>",
    )
    texts = spark.createDataFrame([("营业执照",), ("营业执照副本",), ("食品流通许可证",), ("食品生产许可证",), ("iso9001",), ("质量体系的认证",), ("无关",)], "text string")
    got = {r["text"]: (r["cert_code"], r["score"]) for r in C.suggest_cert(texts, certs).collect()}
    assert got["营业执照"] == ("BUSINESS-LICENSE", 1.0) and "营业执照副本" not in got and got["食品流通许可证"] == ("FOOD-BUSINESS-LICENSE", 0.95)
    assert "食品生产许可证" not in got and got["iso9001"] == ("ISO-9001-2015", 0.8) and got["质量体系的认证"][0] == "ISO-9001-2015" and "无关" not in got


def test_validity_edges(spark):
    o = dt.date(2025, 1, 1)
    rows = [(o + dt.timedelta(days=n),) for n in (-1, 89, 90)] + [(None,)]
    assert values(spark, rows, "d date", C.classify_validity(F.col("d"), F.lit(o))[0]) == ["expired", "expiring_soon", "valid", "unknown"]


def test_labelled_fields_and_codes(spark):
    pages = spark.createDataFrame([(1, 1, "项目名称： 某 学校食堂项目\n采购人：\n某小学\n预算金额：100元"), (1, 2, "项目名称：另一个项目名")], "doc int, page int, text string")
    got = {(r["page"], r["field"]): r["value"] for r in X.extract_labelled_fields(pages).collect()}
    assert got[(1, "project_name")] == "某学校食堂项目" and got[(1, "owner_unit")] == "某小学" and (2, "project_name") not in got
    codes = values(spark, ["采购计划编号：441301-2025-03605 采购项目编号：HZJJ-2025118号", "采购计划编号：441301 - 2025 - 03605", "项目编号：1234567", None], "t string", X.extract_plan_codes(F.col("t")))
    assert codes[0]["plan_code"] == "441301-2025-03605" and codes[0]["project_code"] == "HZJJ-2025118号" and codes[1]["plan_code"] == "441301-2025-03605" and codes[2]["project_code"] is None


def test_labelled_field_shapes(spark):
    texts = [
        "采购人：\n联系方式：1\n招标人：乙公司\n开标时间：2025年11月20日\n预算金额：9,000,000.00元\n地址：广东省惠州市江北 1 号",
        "采购人：甲\n业主单位：某大学\n预算金额：面议\n截标日期：待定\n地址：采购中心大楼\n项目编号：1234567",
        "", None, "项目名称：短名",
    ]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc int, page int, text string")
    got = {}
    for r in X.extract_labelled_fields(df).collect():
        got.setdefault(r["doc"], {})[r["field"]] = r["value"]
    assert got[0] == {"owner_unit": "乙公司", "bid_open_date": "2025-11-20", "budget_amount": "9000000", "region": "广东省惠州市"}
    assert got[1] == {"owner_unit": "某大学"} and set(got) == {0, 1}


def test_clone_names_fill_gaps(spark):
    sources = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id long, name string")
    used = spark.createDataFrame([("a - 重投",), ("a - 重投 (3)",), ("a - 重投 (03)",), ("b",)], "name string")
    got = {r["source_id"]: r["name"] for r in L.clone_projects(sources, used, "rebid").collect()}
    assert got == {1: "a - 重投 (2)", 2: "a - 重投 (4)", 3: "a - 重投 (5)", 4: "b - 重投"}
    got = L.clone_projects(sources.where("id = 4"), used, "annual_renewal", 2026).first()
    assert got["name"] == "b - 2026" and got["parent_id"] is None and not got["is_retender"]


def test_license_requirements_images(spark):
    f = values(spark, [("某某有限公司\n统一 91440101MA5XXXXX1Q\n住所：广州", "license"), ("食品经营许可证 证书编号：JY12345678901", "cert"), ("x", "other")], "t string, k string", X.extract_license_fields(F.col("t"), F.col("k")))
    assert [x["field"] for x in f[0]] == ["credit_code", "company_name", "address"] and f[1][1]["value"] == "JY12345678901" and f[2] == []
    df = spark.createDataFrame([(1, '{"qualifications":[{"title":"食品经营许可证"},{"cert_name":"营业执照"},{"title":"★条款","type":"x"},{"type":"军采"}]}')], "project int, json string")
    assert [r["cert_code"] for r in X.normalise_requirements(df).collect()] == ["FOOD_OPERATION_LICENSE", "BUSINESS_LICENSE", "SUBSTANTIAL_CLAUSE", "MILITARY_SPECIAL"]
    assert values(spark, [(900, 100), (500, 100), (300, 100), (900, 1000)], "w int, h int", X.classify_image(F.col("w"), F.col("h"))) == ["business_license", "certification", "other", "other"]


def test_tables_dimensions_defaults(spark):
    cells = spark.createDataFrame([(1, 0, ["name", "value"]), (1, 1, ["quality"]), (1, 2, ["", ""]), (2, 0, ["a", "b"])], "doc int, row int, cells array<string>")
    assert [tuple(r) for r in S.table_to_markdown(cells).collect()] == [(1, "| name | value |\n| --- | --- |\n| quality |  |")]
    docs = spark.createDataFrame([(1, "前言\n冷链管理 甲乙\n服务方案 丙"), (2, "没有")], "doc int, text string")
    got = {(r["doc"], r["dimension"]): r["body"].strip() for r in X.chunk_by_dimensions(docs, ("冷链管理", "服务方案")).collect()}
    assert got == {(1, "冷链管理"): "甲乙", (1, "服务方案"): "丙", (2, None): "没有"}
    rows = spark.createDataFrame([("  ", None, None), ("n" * 600, Decimal(1), "open")], "name string, winning_price decimal(15,2), status string")
    got = B.tender_defaults(rows).collect()
    assert got[0]["name"] == "未命名" and not got[0]["price_revealed"] and got[0]["status"] == "closed" and len(got[1]["name"]) == 500


def test_scan_and_write(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "deep" / "b.DOCX").write_bytes(b"x")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    found = B.scan_documents(spark, str(tmp_path / "in")).collect()
    assert len(found) == 2 and len({r["hash"] for r in found}) == 1
    B.write_chunks(spark.createDataFrame([(1, "positive"), (2, "negative")], "id int, win_signal string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("win_signal = 'positive'").count() == 1


def test_streams_agree_with_batches(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id project", "event_id", "ts at", "event_type new_status")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = jobs.running_state(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, jobs.running_state(log).collect()))


def test_ingest_twice_adds_nothing_and_names_broken_files(spark, tmp_path):
    src, at = tmp_path / "src", {n: str(tmp_path / n) for n in ("t", "l", "c")}
    write = lambda name, rows: spark.createDataFrame([(r,) for r in rows], "content string").coalesce(1).write.parquet(str(src / name))
    run = lambda **more: jobs.ingest_chunks(spark, str(src), at["t"], at["l"], at["c"], **more)
    write("a", ["one", "two", None])
    write("b", ["two", "three"])
    whole = next((src / "a").glob("*.parquet")).read_bytes()
    (src / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (src / "big.parquet").write_bytes(whole + b" " * 5000)
    write("none", [])
    states = lambda: {r["path"].split("/src/")[1].split("/")[0]: r for r in jobs.file_states(spark, at["t"], at["l"]).collect()}
    contents = lambda: sorted(r["content"] for r in spark.read.option("recursiveFileLookup", True).parquet(at["t"]).collect())
    run(most_bytes=4000)
    assert contents() == ["one", "three", "two"]
    got = states()
    assert {n: r["state"] for n, r in got.items()} == {"a": "processed", "b": "processed", "cut.parquet": "unreadable", "big.parquet": "unreadable", "none": "skipped"}
    assert got["a"]["chunks"] == 2 and got["a"]["nulls"] == 1 and "over 4000 bytes" in got["big.parquet"]["error"] and got["cut.parquet"]["error"] and not got["cut.parquet"]["fatal"]
    run(most_bytes=4000)
    assert len(states()) == 5 and contents() == ["one", "three", "two"]
    write("d", ["three", "four"])
    run()
    assert contents() == ["four", "one", "three", "two"] and states()["d"]["chunks"] == 1
    # a fatal file ends the run and is recorded; the next run takes up the batch again
    (src / "x.parquet").write_bytes(b"junk")
    write("e", ["five"])
    with pytest.raises(Exception, match="x.parquet"):
        run(stop_on_error=True)
    assert states()["x.parquet"]["fatal"] and "five" not in contents()
    run()
    assert contents() == ["five", "four", "one", "three", "two"] and not states()["x.parquet"]["fatal"]


def test_replay_in_order_of_shuffled_files(spark, tmp_path):
    shape = "project long, event_id long, at timestamp, original_status string, new_status string"
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    rows = [(1, 3, day(3), "b", "c"), (1, 1, day(1), None, "a"), (1, 2, day(2), "x", "b"), (2, 5, day(1), "q", "a"), (1, 4, day(3), "c", "d"), (None, 9, day(1), "a", "a"), (2, 6, day(2), "a", "b")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run = lambda: jobs.keep_replay(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), "10 days", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    for n in (50, 51):
        spark.createDataFrame([(7, n, day(n), "end", "end")], shape).write.mode("append").parquet(str(tmp_path / "log"))
        run()
    # a row later than the allowed lateness is dropped
    spark.createDataFrame([(1, 8, day(1), "d", "z")], shape).write.mode("append").parquet(str(tmp_path / "log"))
    run()
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    got = {(r["project"], r["n"]): (r["event_id"], r["before"], r["gap"]) for r in out.where("project < 7").collect()}
    assert got == {(1, 1): (1, None, False), (1, 2): (2, "a", True), (1, 3): (3, "b", False), (1, 4): (4, "c", False), (2, 1): (5, None, False), (2, 2): (6, "a", False)}
    batch = spark.createDataFrame(rows, shape).where("project is not null")
    assert {(r["project"], r["event_id"]) for r in L.audit_gaps(batch).collect()} == {(r["project"], r["event_id"]) for r in out.where("gap").collect()}
    last = {r["project"]: r["status"] for r in L.current_status(batch).collect()}
    assert last == {r["project"]: r["s"] for r in out.where("project < 7").groupBy("project").agg(F.max_by("new_status", "n").alias("s")).collect()}


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [3.0, 0.0, 4.0], 0.6), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, want):
    from tenderspark.operators.retrieval import cosine_similarity

    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert abs(df.select(cosine_similarity(F.col("a"), F.col("b"))).first()[0] - want) < 1e-12


def test_strip_is_that_of_python(spark):
    rows = [c + "a" + c for c in map(chr, range(1, 0x3100)) if c.isspace() or c in "\u200b\x00x"]
    assert values(spark, rows, "t string", T.strip(F.col("t"))) == [r.strip() for r in rows]


def test_headers_and_boilerplate(spark):
    docs = spark.createDataFrame([(1, "前言\n　　一、总则\n甲 服务 方案\n\t第二章 要求\n\n乙\n　 \n")], "doc int, text string")
    got = [(r["title"], r["body"], r["tags"]) for r in S.segment_by_header(docs).orderBy("seg").collect()]
    assert got == [("", "前言", []), ("一、总则", "甲 服务 方案", ["服务方案"]), ("第二章 要求", "乙", [])]
    merged = S.merge_short_segments(S.segment_by_header(docs)).collect()
    assert [(r["title"], r["body"], r["tags"]) for r in merged] == [("", "前言\n甲 服务 方案\n乙", ["服务方案"])]
    blocks = [("table", "目录" + "x" * 27), ("table", "x" * 19), ("paragraph", "目录" + "x" * 40), ("paragraph", "目录\n" + "x" * 40 + "方案"), ("paragraph", "　" * 20 + "x" * 29), ("paragraph", "\n目录" + "x" * 40), ("paragraph", " \n"), ("paragraph", None)]
    kept = S.filter_boilerplate(spark.createDataFrame([(i, *b) for i, b in enumerate(blocks)], "i int, block_type string, content string"), ("方案",), ("目录",))
    assert sorted(r["i"] for r in kept.collect()) == [0, 3, 5]


def test_chunks_of_a_long_text_take_time_by_its_length():
    import time

    took = []
    for n in (1, 8):
        text = ("words of a sentence. " * 50_000 + "x" * 10_000) * n
        start = time.perf_counter()
        cuts = T.cut_points(text, 500, 50, 0.3)
        took.append(time.perf_counter() - start)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(start == end - 50 and stop - start <= 500 for (_, end), (start, stop) in zip(cuts, cuts[1:]))
    assert took[1] < 30 * took[0]


CERT = "cert_id int, cert_code string, cert_full_name string, cert_short_name string, aliases array<string>, required_keywords array<string>, exclude_keywords array<string>"


def plain_score(text, cert):
    """The score of one certificate, step by step."""
    from difflib import SequenceMatcher

    low, score = text.lower(), 0.0
    if any(w.lower() in low for w in cert[6] or []):
        return 0.0
    either = lambda a: bool(a) and (a.lower() in low or low in a.lower())
    if text == cert[2]:
        return 1.0
    if either(cert[2]):
        score = 0.9
    if cert[3] and text == cert[3]:
        score = max(score, 0.9)
    elif either(cert[3]):
        score = max(score, 0.8)
    for alias in cert[4] or []:
        if not alias:
            continue
        if alias.lower() == low:
            return 0.95
        if either(alias):
            score = max(score, 0.8)
            break
        if score < 0.6:
            ratio = SequenceMatcher(None, low, alias.lower()).ratio()
            score = max(score, ratio * 0.7) if ratio > 0.6 else score
    return max(score, 0.5) if score < 0.5 and any(w.lower() in low for w in cert[5] or []) else score


def test_suggest_cert_is_every_pair_scored(spark):
    import random

    r = random.Random(4)
    word = lambda a, b: "".join(r.choice("abcdABé营业") for _ in range(r.randint(a, b)))
    some = lambda n, a, b: r.choice([None, [], [word(a, b) for _ in range(r.randint(1, n))]])
    certs = [(k, f"c{k}", word(0, 9), r.choice([None, "", word(1, 5)]), some(4, 0, 9), some(2, 1, 3), some(2, 2, 4)) for k in range(150)]
    texts = {word(1, 10) for _ in range(400)} | {c[2] for c in certs[:20]} | {"", " \u3000", " ab "}
    want = {}
    for t in texts:
        bare = t.strip()
        scores = [(-plain_score(bare, c), c[0]) for c in certs] if bare else []
        if scores and round(-min(scores)[0], 2) >= 0.5:
            want[t] = (f"c{min(scores)[1]}", round(-min(scores)[0], 2))
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for size in (20_000, 37):
        got = {x["text"]: (x["cert_code"], x["score"]) for x in C.suggest_cert(rows, spark.createDataFrame(certs, CERT), size=size).collect()}
        assert got == want and len(want) > 200
    assert C.suggest_cert(rows, spark.createDataFrame([], CERT)).count() == 0
    one = spark.createDataFrame([(1, "c", "zzz", None, ["abc", "abcdefghij"], [], [])], CERT)
    assert C.suggest_cert(spark.createDataFrame([("abcdefghij",)], "text string"), one).first()["score"] == 0.8


def test_only_likely_pairs_are_compared():
    from difflib import SequenceMatcher
    import random

    from tenderspark.operators.names import SharedCharacters

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 12))) for _ in range(400)]
    index = SharedCharacters(words)
    for text in words[:60]:
        over = set(index.over(text, 0.6))
        assert {k for k, w in enumerate(words) if SequenceMatcher(None, text, w).ratio() > 0.6} <= over and len(over) < len(words)


def plain_outcomes(tenders, book):
    """The book as dictionaries, looked up level by level."""
    import re

    def bare(name):
        for s in T.DOC_SUFFIXES:
            if name.endswith(s):
                return name[: -len(s)]
        return re.sub(r"_采购包\s*\d+$", "", name)

    by_id, by_hash, by_name = {}, {}, {}
    for i, h, n, status, _ in book:
        sign = {"won": "positive", "lost": "negative", "failed": "negative"}.get(status, "neutral")
        if i is not None:
            by_id[i] = sign
        if h:
            by_hash[h] = sign
        for key in (n, bare(n)) if n else ():
            if key:
                by_name[key] = sign
    out = {}
    for i, h, n in tenders:
        hit = (1, by_id[i]) if i in by_id else (2, by_hash[h]) if h in by_hash else (3, by_name[n]) if n in by_name else (3, by_name[bare(n)]) if n and bare(n) in by_name else None
        out[i] = hit or next(((4, s) for key, s in by_name.items() if n and (key in n or n in key)), (None, "neutral"))
    return out


def test_outcomes_are_those_of_dictionaries(spark):
    import random

    r = random.Random(8)
    name = lambda: "".join(r.choice("甲乙丙X") for _ in range(r.randint(1, 7))) + r.choice(["", "", "_投标文件", "_采购包 3"])
    book = [(r.choice([None, None, k]), r.choice([None, f"h{k % 20}"]), r.choice([None, name()]), r.choice(["won", "lost", "failed", "open"]), k) for k in range(60)]
    tenders = [(k, f"h{k}", r.choice([name(), name(), None])) for k in range(10, 250)]
    b = spark.createDataFrame(book, "tender_id long, hash string, name string, status string, line long")
    t = spark.createDataFrame(tenders, "id long, hash string, name string")
    got = {x["id"]: (x["level"], x["win_signal"]) for x in B.resolve_outcome(t, b).collect()}
    assert got == plain_outcomes(tenders, book) and {lv for lv, _ in got.values()} == {None, 1, 2, 3, 4}
    one = spark.createDataFrame([(None, None, "X项目_投标文件", "won", 1)], "tender_id long, hash string, name string, status string, line long")
    assert B.resolve_outcome(spark.createDataFrame([(1, "h", "甲X项目乙")], "id long, hash string, name string"), one).first()["win_signal"] == "positive"


def test_book_columns_and_hashes_of_files(spark, tmp_path):
    p = tmp_path / "book.csv"
    p.write_text('project_name,tender_file_name ,our_bid_status,key_win_factors,score_max,confidential_level,notes\n甲,a.pdf,　WON ,"[1, ""x""]",99.5,,\n乙,b.pdf,Lost,{},x,secret,n\n', encoding="utf-8")
    book = B.read_outcome_book(spark, str(p))
    rows = {r["project_name"]: r for r in book.collect()}
    assert rows["甲"]["our_bid_status"] == "won" and rows["甲"]["key_win_factors"] == ["1", "x"] and rows["甲"]["score_max"] == Decimal("99.5") and rows["甲"]["confidential_level"] == "internal"
    assert rows["乙"]["win_signal"] == "negative" and rows["乙"]["key_win_factors"] == [] and rows["乙"]["score_max"] is None and rows["乙"]["notes"] == "n" and rows["甲"]["notes"] is None
    files = spark.createDataFrame([("file:/x/a.pdf", "h1"), ("file:/y/a.pdf", "h2")], "path string, hash string")
    got = {r["project_name"]: r["tender_file_hash"] for r in B.hash_from_files(book, files).collect()}
    assert got == {"甲": "h1", "乙": None}


def test_history_in_bands(spark):
    import random

    r = random.Random(2)
    shape = "id long, region string, project_type string, budget decimal(15,2), cost decimal(15,2)"
    rows = [(k, r.choice("ab"), r.choice(["x", None]), r.choice([None, Decimal(r.randint(0, 400)), Decimal(r.randint(80, 130))]), Decimal(r.randint(1, 99))) for k in range(300)]
    df = spark.createDataFrame(rows, shape)
    want = {}
    for i, region, kind, b, _ in rows:
        near = [h for h in rows if b is not None and h[3] and kind and (h[1], h[2]) == (region, kind) and b * 4 <= h[3] * 5 and h[3] * 5 <= b * 6]
        if near:
            want[i] = (len(near), min(h[0] for h in near), float(sum(h[3] for h in near)))
    before = P.SWEEP
    for P.SWEEP in (before, 7):
        found = P.similar_summary(df, df)
        assert {x["id"]: (x["n"], x["first"], x["budgets"]) for x in found.collect()} == want
    P.SWEEP = before
    pairs = {x["id"]: x["n"] for x in P.similar_history(df.where("budget > 0"), df.where("budget > 0")).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert pairs == {k: v[0] for k, v in want.items()}
    est = {x["id"]: x for x in P.estimate_from_history(df, found).collect()}
    one = next(k for k in want if want[k][0] == 1)
    assert est[one]["confidence"] == "low" and not est[one]["fallback"] and all(est[i]["fallback"] == (i not in want) for i in est)


def test_best_chunks_of_odd_vectors(spark):
    from tenderspark.operators import retrieval as R

    nan = float("nan")
    vectors = [[1.0, 0.0], [0.0, 0.0], [2.0, 0.0, 5.0], [0.0, 1.0], [nan, 1.0], [None, 1.0], None, [1.0, 0.0], [3.0, 1.0]]
    chunks = spark.createDataFrame([(k, 1 if k else None, v, False, "t" if k % 2 else "u") for k, v in enumerate(vectors)] + [(99, 1, [1.0, 0.0], True, "t")], "chunk_id long, project int, vector array<double>, is_deprecated boolean, chunk_type string")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 1, [0.0, 0.0])], "query_id long, project int, query_vector array<double>")
    got = {}
    sizes = R.VECTORS, R.QUERIES
    for R.VECTORS, R.QUERIES in (sizes, (2, 1)):
        got = {}
        for x in R.search(chunks, asked, 3).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["chunk_id"], round(x["score"], 6)))
        assert got == {1: [(7, 1.0), (8, 0.948683), (2, 0.371391)], 3: [(1, 0.0), (2, 0.0), (3, 0.0)]}
    R.VECTORS, R.QUERIES = sizes
    assert [x["chunk_id"] for x in R.search(chunks, asked.where("query_id = 1"), 3, "t").orderBy("rank").collect()] == [7, 1, 3]
    assert R.search(chunks.limit(0), asked).count() == R.search(chunks, asked.limit(0)).count() == 0


def test_lifecycle_reports_and_traps(spark):
    from tenderspark.operators import outcomes as O

    rows = spark.createDataFrame([(1, "p", None, "n", False, "terminated_by_boss", False), (2, "p", None, "n", False, "evaluating", False), (3, "p", "", "", False, "created", False)], "id long, plan_code string, agency_code string, name string, deleted boolean, status string, force boolean")
    assert sorted(tuple(x) for x in L.find_duplicates(rows, rows).collect()) == [(1, "plan_code", 2), (3, "plan_code", 2)]
    assert [x["id"] for x in L.list_projects(rows.withColumn("owner_unit", F.lit("a")), "boss").collect()] == [3, 2, 1]
    traps = spark.createDataFrame([("t", "OLD", 2)], "title string, code string, n int")
    new = spark.createDataFrame([(7, None, None), (8, "", "u"), (9, "seal", "t")], "id long, category string, reason string")
    assert {x["title"]: (x["code"], x["n"]) for x in O.upsert_traps(traps, new).collect()} == {"Unknown disqualification": ("TRAP_format_7", 1), "u": ("TRAP_format_8", 1), "t": ("OLD", 3)}
    now = dt.datetime(2025, 3, 31, 12)
    at = [now - dt.timedelta(days=n, seconds=s) for n, s in ((30, 0), (30, 1), (60, 0), (60, 1), (-1, 0))]
    e = spark.createDataFrame([(a, True, float(q)) for a, q in zip(at, (10, 20, 30, 1000, 10))], "at timestamp, is_deprecated boolean, quality double")
    got = O.evolution_report(e, e, e, e, F.lit(now)).first()
    assert (got["deprecated"], got["new_dna"], got["quality"], got["trend"]) == (2, 2, 10.0, "down")


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    from tenderspark.operators import snapshots as V

    root = str(tmp_path / "v")
    rows = spark.range(2000).selectExpr("id", "concat('a', id) AS name", "id % 7 AS n")
    assert V.commit(spark, root, {"t": (rows, ["id"])}, buckets=256) == 0
    ids = [3, 500, 1999, 5000]
    news = spark.createDataFrame([(i, f"b{i}", k) for i in ids for k in (1, 2)], "id long, name string, at int")
    assert V.commit(spark, root, {"t": (news, ["id"])}, {"t": "at"}) == 1 and V.versions(spark, root) == [0, 1]
    old, new = (V._version(spark, root, k)["t"]["folders"] for k in (0, 1))
    touched = {str(r[0]) for r in news.select(V.bucket_of(["id"], 256)).distinct().collect()}
    assert {b for b in new if new[b] != old.get(b)} == touched and len(touched) <= 4
    got = {r["id"]: (r["name"], r["n"]) for r in V.read_table(spark, root, "t").collect()}
    assert len(got) == 2001 and got[3] == ("b3", 3) and got[5000] == ("b5000", None) and got[4] == ("a4", 4)
    assert V.read_table(spark, root, "t", 0).where("name like 'b%'").count() == 0
    # a failure between two tables shows none of them, and the version before stays
    broken = F.udf(lambda i: 1 // (i - i), "long")("id")
    more = spark.range(5).selectExpr("id", "'c' AS name", "id AS n")
    with pytest.raises(Exception):
        V.commit(spark, root, {"t": (more, ["id"]), "u": (more.withColumn("n", broken), ["id"])})
    assert V.versions(spark, root) == [0, 1] and V.read_table(spark, root, "t").where("name = 'c'").count() == 0
    with pytest.raises(KeyError):
        V.read_table(spark, root, "u")
    with pytest.raises(ValueError):
        V.commit(spark, root, {"t": (more, ["name"])})
    assert V.commit(spark, root, {"t": (more.limit(0), ["id"]), "u": (more.limit(0), ["id"])}) == 2
    assert V.read_table(spark, root, "t").count() == 2001 and V.read_table(spark, root, "u").count() == 0
    nulls = spark.createDataFrame([(None, "x", 1)] * 2, "id long, name string, n long")
    V.commit(spark, root, {"u": (nulls, ["id"])})
    V.commit(spark, root, {"u": (nulls.limit(1), ["id"])})
    assert V.read_table(spark, root, "u").count() == 3
