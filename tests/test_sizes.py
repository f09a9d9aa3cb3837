"""Queries on keys and groups that only larger tables have."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tenderspark import registry
from tests.compare import TABLES, database, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def executed(df) -> list:
    """The operators that a DataFrame ran, those of its stages too."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            found.append(p)
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def rows_of_joins(df) -> int:
    """Most rows that any join of a DataFrame made."""
    joins = [p for p in executed(df) if "Join" in p.getClass().getSimpleName()]
    return max(p.metrics().apply("numOutputRows").value() for p in joins)


def changed(folder, **tables: str) -> str:
    """The smallest tables, of which some are given by a SELECT."""
    con = duckdb.connect()
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet") if t not in tables else con.execute(f"COPY ({tables[t].format(f"'{SF}/{t}.parquet'")}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def test_outcomes_without_broadcasts(spark):
    kinds = [p.getClass().getSimpleName() for p in executed(registry.QUERIES["a3_resolve_outcome"](spark, SF))]
    assert "SortMergeJoinExec" in kinds and not [k for k in kinds if "Broadcast" in k]


def test_duplicates_of_a_common_key_make_no_pairs(spark):
    from tenderspark.operators import lifecycle as L

    rows = spark.range(1000).selectExpr("id", "CAST(NULL AS STRING) plan_code", "CAST(NULL AS STRING) agency_code", "'n' name", "false deleted", "'evaluating' status", "false force")
    df = L.find_duplicates(rows, rows.union(rows))
    assert {r["id"]: r["match"] for r in df.collect()} == {k: 0 if k else 1 for k in range(1000)}
    assert rows_of_joins(df) <= 1000


@pytest.mark.parametrize("name", ["d6_confirmation_summary", "d7_apply_corrections"])
def test_ids_that_orders_share(spark, tmp_path, name):
    """Parts of 100,000 and more reach into the next order's ids."""
    key = "{k} // 2 + 100000 * ({k} % 2) AS {k}"
    tables = {t: f"SELECT * REPLACE ({key.format(k=k)}) FROM {{}}" for t, k in (("part", "p_partkey"), ("lineitem", "l_partkey"))}
    d = changed(tmp_path, **tables)
    assert spark_rows(registry.QUERIES[name](spark, d)) == duck_rows(database(d), registry.ORACLES[name])


def test_many_similar_budgets_at_once(spark):
    """Sums over windows of thousands of rows equal those of the rows, and no task takes a time for each pair."""
    import time

    import numpy as np

    from tenderspark.operators import pricing as P

    rng = np.random.default_rng(3)
    h, b = np.sort(rng.integers(8_000_000, 20_000_000, 400_000)), np.sort(rng.integers(9_000_000, 16_000_000, 50_000))
    by = [rng.integers(1, 4, len(h)), rng.random(len(h)) * 1e5]
    start, end = np.searchsorted(h, b, "right"), np.searchsorted(h * 1000, b * 1200, "right")
    began = time.time()
    got, least = P._above(b, h, by, start, end), P._least(by[1], start, end)
    assert time.time() - began < 20
    for at in range(0, len(b), 997):
        s = slice(start[at], end[at])
        want = [(v[s] * h[s] / (2 * h[s] - b[at])).sum() for v in by]
        assert all(abs(g[at] - w) <= 1e-11 * w for g, w in zip(got, want)) and least[at] == by[1][s].min()

    n = 60_000
    history = spark.range(n).selectExpr("id", "'r' region", "'t' project_type", "CAST(100000 + id AS DECIMAL(15,2)) budget", "CAST(1000 + id % 7 AS DECIMAL(15,2)) cost")
    got = {r["id"]: r for r in P.similar_summary(history, history).collect()}
    for k in (0, 12345, n - 1):
        x, rows = 100000 + k, np.arange(100000, 100000 + n)
        rows = rows[(rows >= 0.8 * x) & (rows <= 1.2 * x)]
        weight = rows / (rows + abs(x - rows))
        r = got[k]
        assert (r["n"], r["first"], r["budgets"]) == (len(rows), rows[0] - 100000, rows.sum())
        assert abs(r["weights"] - weight.sum()) < 1e-9 * r["weights"] and abs(r["costs"] - (weight * (1000 + (rows - 100000) % 7)).sum()) < 1e-9 * r["costs"]


def test_few_scores_in_memory_at_once(spark, monkeypatch):
    from tenderspark.operators import retrieval as R

    v = lambda name: F.expr(f"array(cos(id * 1.7), sin(id * 1.3), cos(id * id)) AS {name}")
    side = spark.range(40).select(F.lit(0).alias("scope"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("track"), F.col("id").alias("chunk_id"), v("vector"))
    asked = spark.range(100, 110).select(F.lit(0).alias("scope"), F.col("id").alias("query_id"), v("query_vector"))
    whole = sorted(map(tuple, R._best(side, asked, 4).collect()))
    monkeypatch.setattr(R, "ROWS", 3)
    assert len(whole) == 80 and sorted(map(tuple, R._best(side, asked, 4).collect())) == whole


def test_pages_as_files_in_few_folders(spark, tmp_path, monkeypatch):
    """Every page is a file, those of a repeated id too, and folders do not grow with the pages."""
    from tenderspark.plans import stored

    (tmp_path / "in").mkdir()
    monkeypatch.setattr(stored, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    d = changed(tmp_path / "in", pages="SELECT * REPLACE (page_id // 3 + 1000 * (k % 20) AS page_id) FROM {}, range(60) r(k)")
    assert spark_rows(registry.QUERIES["a5_scan_documents"](spark, d)) == duck_rows(database(d), registry.ORACLES["a5_scan_documents"])
    at = [(len(names), len(folders)) for _, folders, names in os.walk(tmp_path / "files")]
    assert sum(n for n, _ in at) == 3000 and sum(n for _, n in at) <= 110


def test_conversations_as_files_in_few_folders(spark, tmp_path, monkeypatch):
    """Files of a batch are listed by few tasks, and folders do not grow with the files."""
    from tenderspark.plans import stored
    from tenderspark.streaming import jobs

    key, seen, parsed = "spark.sql.sources.parallelPartitionDiscovery.parallelism", [], jobs.parsed_files
    (tmp_path / "in").mkdir()
    monkeypatch.setattr(stored, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(jobs, "parsed_files", lambda files, *a: seen.append(int(files.sparkSession.conf.get(key))) or parsed(files, *a))
    d, before = changed(tmp_path / "in", conversations="SELECT * REPLACE (conv_id + 100 * k AS conv_id) FROM {}, range(20) r(k)"), spark.conf.get(key)
    assert spark_rows(registry.QUERIES["a10_import_totals"](spark, d)) == duck_rows(database(d), registry.ORACLES["a10_import_totals"])
    assert len(seen) == 2 and max(seen) <= 16 and spark.conf.get(key) == before
    at = [(sum(n.endswith(".parquet") for n in names), len(folders)) for _, folders, names in os.walk(tmp_path / "ingest/source")]
    n = database(d).execute("SELECT count(DISTINCT conv_id) FROM conversations").fetchone()[0]
    assert n > 300 and sum(x for x, _ in at) == 2 * n and sum(x for _, x in at) <= 2 * 110 + 3


def test_a_text_is_not_read_again_for_each_of_its_parts(spark):
    """The test for names is no column beside the parts, where it would take the whole text for each."""
    from tenderspark.functions import extract as X

    docs = spark.range(1).selectExpr("id AS doc", "repeat(if(id < 5, 'and word ', 'x'), 1000) AS text")
    df = X.chunk_by_dimensions(docs, ("and", "der"))
    assert sorted((r["seg"], r["dimension"], r["body"]) for r in df.collect()) == [(k, "and", "word") for k in range(1000)]
    tests = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RLIKE" in line.upper()]
    assert tests and all("Generate inline" in line for line in tests)


def test_replay_keeps_projects_in_few_states(spark, tmp_path):
    """Calls and states do not grow with the projects, and later batches go on from what each project had."""
    from tenderspark.streaming import jobs

    at = lambda name: str(tmp_path / name)
    log = spark.range(6000).selectExpr("id % 2000 project", "id event_id", "timestamp '2025-01-01' + make_interval(0, 0, 0, cast(id div 2000 AS int)) at", "if(id < 2000, null, 'a') original_status", "if(id < 4000, 'a', null) new_status")
    end = spark.sql("SELECT -1L project, -1L event_id, timestamp '2026-01-01' at, 'end' original_status, 'end' new_status")
    for rows in (log.where("event_id < 2000"), end.withColumn("at", F.expr("timestamp '2025-01-03 12:00:00'")), log.where("event_id >= 2000 and project > 0").unionByName(end), end):
        rows.coalesce(1).write.mode("append").parquet(at("log"))
        q = jobs.keep_replay(spark.readStream.schema(log.schema).parquet(at("log")), "2 days", at("out"), at("c"))
        q.awaitTermination()
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 256
    out = spark.read.option("recursiveFileLookup", True).parquet(at("out")).where("project >= 0")
    assert {(r["n"], r["before"], r["gap"]): r["c"] for r in out.groupBy("n", "before", "gap").agg(F.count("*").alias("c")).collect()} == {(1, None, False): 2000, (2, "a", False): 1999, (3, "a", False): 1999}


def related_by_pairs(names: list, keys: list) -> dict:
    every = {n: [p for k, p in keys if k and p is not None and (k in n or n in k)] for n in names if n}
    return {n: min(ps) for n, ps in every.items() if ps}


@pytest.mark.parametrize("rows, heads", [(3, 1000), (7, 4), (20, 0), (50_000, 50_000)])
def test_related_names_in_blocks_of_any_size(spark, rows, heads):
    """Blocks that end within equal suffixes or within what goes on from one name, and beginnings that tell much or nothing."""
    import random

    from tenderspark.operators.names import first_related

    r = random.Random(rows)
    word = lambda: "".join(r.choice("甲乙X𠮷") for _ in range(r.randint(0, 6))) + r.choice(["", "", "_文件", "_文件_文件"])
    names, keys = [r.choice([word(), word(), word(), None]) for _ in range(150)], [(r.choice([word(), word(), word(), None]), r.choice([k, k, k, None, -k])) for k in range(80)]
    names, keys = names + ["甲甲甲甲甲甲甲甲", "Z"], keys + [("YZ文", 3), ("YZ", 4)]
    got = first_related(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(keys, "key string, place long"), rows, heads).collect()
    assert {x["name"]: x["place"] for x in got} == related_by_pairs(names, keys) and len({x["name"] for x in got}) == len(got)


def test_rows_of_related_names_do_not_grow_with_blocks(spark, monkeypatch):
    """Names that end alike go through exchanges a few times each, however many blocks there are."""
    from tenderspark.operators import names as N
    from tenderspark.operators import steps

    monkeypatch.setattr(steps, "_folder", lambda spark: None)  # one plan of all steps
    names, keys = spark.range(4000).selectExpr("concat('N', id, '_end') AS name"), spark.range(4000).selectExpr("concat('<N', 2 * id, '_end>') AS key", "id AS place")
    df = N.first_related(names, keys, 100)
    assert {(x["name"], x["place"]) for x in df.collect()} == {(f"N{2 * k}_end", k) for k in range(2000)}
    dealt = [p.metrics().apply("shuffleRecordsWritten").value() for p in executed(df) if p.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert len(dealt) > 1 and sum(dealt) < 6 * 8000


def test_steps_of_outcomes_leave_only_what_is_read(spark, tmp_path, monkeypatch):
    """Steps that nothing reads any more are deleted, and a cluster without a folder gives the same rows."""
    from tenderspark.operators import steps

    monkeypatch.setattr(steps, "_folder", lambda spark: f"file://{tmp_path}")
    df = registry.QUERIES["a3_resolve_outcome"](spark, SF)
    assert {f"file://{tmp_path}/{x}" for x in os.listdir(tmp_path)} == {f.rpartition("/")[0] for f in df.inputFiles() if "/step-" in f}
    with_folder = sorted(map(str, df.collect()))
    monkeypatch.setattr(steps, "_folder", lambda spark: None)
    assert sorted(map(str, registry.QUERIES["a3_resolve_outcome"](spark, SF).collect())) == with_folder
