"""Sources, sinks and streams on small folders; streams against their batch forms."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import bench
from ledgerleaf.operators import scoring
from ledgerleaf.plans import flows, registry
from ledgerleaf.sources import buckets, io
from ledgerleaf.streaming import jobs


def record(i, key="reports/2020/a/a.pdf", created="2024-01-01T00:00:00Z", **report):
    return json.dumps({"version": 1, "createdAt": created, "report": {"id": f"report-{i}", "slug": f"s{i}", "company": "Acme", "reportKey": key, "publishedYear": 2020, **report}, "file": {"sha256": f"h{i}"}})


def test_index_and_jsonl(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"id": "1", "k": "a", "y": 2020}, {"id": "2", "k": "a", "y": 2021}, {"id": "3"}, {"id": "4", "k": "b", "y": None}]))
    assert {(r.k, r.id) for r in io.read_report_index(spark, str(tmp_path / "index.json")).collect()} == {("a", "2"), ("b", "4")}
    rows = spark.createDataFrame([("é", None), ("b", 1)], "k string, n int")
    io.write_jsonl(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '{"k":"é","n":null}' in text
    assert io.read_jsonl(spark, str(tmp_path / "out"), "k string, n int").count() == 2


def test_uploads_markdown_and_binaries(spark, tmp_path):
    ups = tmp_path / "ups"
    ups.mkdir()
    (ups / "1.json").write_text(record(1))
    (ups / "2.json").write_text("{broken")
    (ups / "3.json").write_text(record(3, key=None))
    (ups / "x.txt").write_text(record(9))
    assert [r.report_id for r in io.read_upload_records(spark, str(ups)).collect()] == ["report-1"]
    md = tmp_path / "md" / "reports" / "2020" / "a"
    md.mkdir(parents=True)
    (md / "a.md").write_text("line one\nline two")
    assert [tuple(r) for r in io.read_markdown_corpus(spark, str(tmp_path / "md")).collect()] == [("reports/2020/a/a.pdf", "line one\nline two")]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "bin" / "b.pdf").write_bytes(b"nope")
    assert {(r.size, r.has_signature) for r in io.inventory_binaries(spark, str(tmp_path / "bin")).collect()} == {(10, True), (4, False)}


def test_scores_are_replaced_by_key(spark, tmp_path):
    a = spark.createDataFrame([(1, "r1", 10), (1, "r2", 20)], "version int, report_id string, score int")
    b = spark.createDataFrame([(1, "r2", 30), (2, "r1", 40)], a.schema)
    path, show = str(tmp_path / "s"), lambda: {(r.version, r.report_id, r.score) for r in buckets.read_buckets(spark, path, a.schema).collect()}
    assert io.write_scores(a, path) == 2
    for _ in range(2):  # the same batch again
        assert io.write_scores(b, path, 1) == 3
        assert show() == {(1, "r1", 10), (1, "r2", 30), (2, "r1", 40)}
    wider = spark.createDataFrame([(1, "r1", 11, "x")], "version int, report_id string, score int, note string")
    io.write_scores(wider, path)
    io.write_scores(a.where("report_id = 'r2'"), path)  # a narrower batch keeps the other rows' columns
    assert {(r.report_id, r.version): r.note for r in buckets.read_buckets(spark, path, wider.schema).collect()} == {("r1", 1): "x", ("r2", 1): None, ("r1", 2): None}
    assert buckets.count_buckets(spark, path) == 3 and io.write_scores(a.limit(0), path) == 3


def test_batches_read_their_buckets_and_compaction_keeps_the_rest(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "report_id string, n int"
    rows = lambda ids, n: spark.createDataFrame([(f"r{i}", n) for i in ids], kinds)
    show = lambda: {(r.report_id, r.n) for r in buckets.read_buckets(spark, path, rows([], 0).schema).collect()}
    assert show() == set() and buckets.count_buckets(spark, path) == 0
    buckets.upsert_buckets(rows(range(200), 1), path, ["report_id"], 0)
    buckets.upsert_buckets(rows([5], 2), path, ["report_id"], 1)
    written = [p for p in (tmp_path / "t" / "data" / "batch=1").glob("bucket=*")]
    assert len(written) == 1 and buckets.count_buckets(spark, path) == 200
    (tmp_path / "t" / "data" / "batch=2" / "bucket=0").mkdir(parents=True)  # a batch that failed before its manifest
    expected = {(f"r{i}", 2 if i == 5 else 1) for i in range(200)}
    assert show() == expected
    assert buckets.compact_buckets(spark, path) == 1 and show() == expected  # the one bucket that batch 1 replaced
    assert buckets.compact_buckets(spark, path) == 0
    buckets.upsert_buckets(rows(range(200, 210), 3), path, ["report_id"], 2)
    assert len(show()) == buckets.count_buckets(spark, path) == 210


def test_exports(spark, tmp_path):
    row = spark.createDataFrame([("report-1", 'A "B" Co', "DE", None, "Banks, x", 2020, 71.5, "medium", 1.4, 2.5, 3.0, None, "k")], "report_id string, company string, country string, sector string, industry string, year int, score double, band string, completeness double, consistency double, assurance double, transparency double, report_key string")
    io.export_scored_csv(row.coalesce(1), str(tmp_path / "csv"))
    lines = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert lines == [",".join(io.CSV_COLUMNS), 'report-1,"A ""B"" Co",DE,,"Banks, x",2020,72,medium,1,3,3,,k']
    io.export_scored_json(row, str(tmp_path / "json"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "json").glob("part-*")))["subscores"]["consistency"] == 2.5
    log = spark.createDataFrame([("t", "report-1", True)], "t string, report_id string, ok boolean")
    io.append_run_log(log, str(tmp_path / "log"))
    io.append_run_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_catalogue_stream_keeps_the_latest(spark, tmp_path):
    ups, out = tmp_path / "ups", str(tmp_path / "out")
    ups.mkdir()
    (ups / "1.json").write_text(record(1, company="Old"))
    (ups / "2.json").write_text(record(2))
    jobs.stream_catalogue(io.stream_upload_records(spark, str(ups)), out, str(tmp_path / "cp")).awaitTermination()
    (ups / "3.json").write_text(record(1, created="2024-02-01T00:00:00Z", company="New"))
    jobs.stream_catalogue(io.stream_upload_records(spark, str(ups)), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.report_id, r.company) for r in jobs.read_catalogue(spark, out, io.stream_upload_records(spark, str(ups)).schema).collect()} == {("report-1", "New"), ("report-2", "Acme")}
    assert jobs.read_live_count(spark, out).first().n == 2


def test_scores_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([("report-1", "Our scope 1 target is net zero by 2040."), ("report-2", "Nothing to see here.")], "report_id string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    jobs.stream_scores(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    show = lambda df: {(r.report_id, r.score, r.band) for r in df.collect()}
    table = lambda: buckets.read_buckets(spark, str(tmp_path / "out"), scoring.score_reports(docs).schema)
    assert show(table()) == show(scoring.score_reports(docs))
    more = spark.createDataFrame([("report-1", "Nothing here any more."), ("report-3", "Water and waste.")], docs.schema)
    more.write.mode("append").parquet(str(tmp_path / "docs"))
    jobs.stream_scores(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # a restart takes the new files only
    assert show(table()) == show(scoring.score_reports(more.unionByName(docs.where("report_id = 'report-2'"))))


def test_stale_scores(spark):
    docs = spark.createDataFrame([("a", "Our scope 1 target is net zero by 2040."), ("b", None), ("c", "text of water"), ("d", "x")], "report_id string, text string")
    old = spark.createDataFrame([("a", "old"), ("a", "older"), ("b", "old"), ("c", scoring.METHOD_KIND), ("e", "old"), ("d", None)], "report_id string, method_kind string")
    made = {r.report_id: (r.migrated_from, r.method_kind) for r in scoring.stale_scores(old, docs).collect()}
    assert made == {"a": ("old", scoring.METHOD_KIND), "d": (None, scoring.METHOD_KIND)}


def events(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=s), i) for i, (k, s) in enumerate([("a", 0), ("a", 10), ("a", 20), ("a", 61), ("b", 5), ("a", 62), ("a", 71), ("b", 5)])]
    return spark.createDataFrame(rows, "key string, ts timestamp, seq long")


def limit_twin(rows, window, most):
    kept, out = {}, {}
    for key, ts, seq in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        t = int(ts.timestamp() * 1000)
        mine = kept[key] = [x for x in kept.get(key, []) if x > t - window]
        out[seq] = len(mine) < most
        if out[seq]:
            mine.append(t)
    return out


def test_limits(spark):
    rows = events(spark)
    want = limit_twin([tuple(r) for r in rows.collect()], 60_000, 2)
    made = {r.seq: (r.allowed, r.remaining, r.reset_ms) for r in jobs.trailing_limit(rows, 60_000, 2).collect()}
    assert {k: v[0] for k, v in made.items()} == want and made[2] == (False, 0, 40_000) and made[0] == (True, 1, 60_000)
    assert {r.seq: r.n for r in jobs.trailing_counts(rows, 60_000).where("key = 'a'").collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 5: 4, 6: 4}


def test_limit_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = events(spark)
    rows.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = jobs.stream_trailing_limit(stream, 60_000, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    show = lambda df: {(r.seq, r.allowed, r.remaining, r.reset_ms) for r in df.collect()}
    assert show(spark.read.parquet(str(tmp_path / "out"))) == show(jobs.trailing_limit(rows, 60_000, 2))


def test_staging_and_dedupe(spark, tmp_path):
    start = datetime(2024, 1, 1)
    staged = spark.createDataFrame([("a", start), ("b", start), ("c", start)], "token string, created_at timestamp")
    finals = spark.createDataFrame([("a", start + timedelta(hours=2)), ("b", start + timedelta(hours=2, seconds=1))], "token string, finalized_at timestamp")
    assert {r.token: r.outcome for r in jobs.staging_outcomes(staged, finals).collect()} == {"a": "finalized", "b": "expired", "c": "expired"}
    ups = spark.createDataFrame([("h", start), ("h", start), ("g", start)], "sha256 string, ts timestamp")
    ups.write.parquet(str(tmp_path / "ups"))
    stream = jobs.stream_dedupe_uploads(spark.readStream.schema(ups.schema).parquet(str(tmp_path / "ups")))
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    assert spark.table("once").select(F.count_distinct("sha256")).first()[0] == 2


def test_first_upload_of_each_hash_stays(spark, sf):
    made = registry.QUERIES["uploads_without_repeats"](spark, sf).collect()
    assert sorted(r.upload_id for r in made) == list(range(200)) and len({r.sha256 for r in made}) == 200


def test_bench_times_the_text_heavy_queries():
    assert {"rule_counts", "ranked_evidence", "grounded_entities"} <= set(bench.HEADLINE)
    assert set(bench.HEADLINE) - set(__spark_entry__.queries()) <= {n for n in bench.HEADLINE if n.startswith("op") or n == "pipeline"}


def test_small_files_take_a_folder_of_many_and_a_task_of_many(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("doc_id="), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 7, None).otherwise(F.concat(F.lit("é "), F.col("id").cast("string"))).alias("text"))
    twice = rows.where("id = 3").unionByName(rows).repartition(2)
    assert io.write_text_files(twice, f"{tmp_path}/reports") == 301
    assert len(list((tmp_path / "reports").iterdir())) <= 4 and not [p for p in tmp_path.rglob(".*")]
    binaries, texts = io.inventory_binaries(spark, str(tmp_path)), io.read_markdown_corpus(spark, str(tmp_path), extension="txt")
    assert binaries.rdd.getNumPartitions() <= 16 and texts.rdd.getNumPartitions() <= 16
    assert sorted(r.text for r in texts.collect()) == sorted(f"é {i}" for i in [3, *range(300)] if i != 7)  # Spark reads no row of an empty file, here or below
    assert binaries.count() == 300 and all(r.report_key.startswith("reports/") and "/doc_id=" in r.report_key for r in texts.collect())


def test_stored_files_share_folders(spark, sf):
    path = flows._stored(spark, sf, F.lit("x"))
    made = io.inventory_binaries(spark, path, "*.txt").select("path").collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(made) == n and len({r.path.rsplit("/", 1)[0] for r in made}) <= n // 10


def test_tasks_list_and_read_stored_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "a b"
    for name, held in (("reports/2020/a é%20#.md", b"%PDF-\xff"), ("reports/2020/_b.md", b"b"), ("reports/_h/c.md", b"c"), (".d/d.md", b"d"), ("reports/_p=1/e.md", b"e\n"), ("empty.md", b""), ("f.md", b"f"), ("g.txt", b"g")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(held)
    show = lambda df: sorted(tuple(r) for r in df.selectExpr(*[f"hex({c})" for c in df.columns]).collect())
    both = lambda: [*(show(io.inventory_binaries(spark, str(root), g)) for g in ("*", "*.{md,x}", "[ae]*")), show(io.read_markdown_corpus(spark, str(root), "x/"))]
    made = both()
    names = [io.inventory_binaries(spark, str(root)), io.read_markdown_corpus(spark, str(root))]
    assert not any(df.inputFiles() and any("a%20b" in f for f in df.inputFiles()) for df in names)  # the driver's plan knows no file of the folder
    monkeypatch.setattr(io, "_folder", lambda *_: None)  # as Spark's readers list and read them
    assert made == both() and [len(m) for m in made] == [4, 3, 2, 3]
