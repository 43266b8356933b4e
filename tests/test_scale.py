"""Streams, sweeps, layouts, indexes and growing tables, on small cases that can be told by hand or by plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import TINY
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F
from tidemark.operators import enrich, features, marts, quality, retrieval, search, vectors
from tidemark.plans import incremental
from tidemark.sources import fixtures as fx
from tidemark.sources import layout, tables
from tidemark.streaming import live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


# ---------------------------------------------------------------- streams


def moves(spark, rows):
    """(id, customer, day, amount) as transactions."""
    made = [(i, c, None if day is None else START + timedelta(days=day), float(a), "DECLINED" if i % 2 else "APPROVED", i % 3 == 0, True, False, True) for i, c, day, a in rows]
    return spark.createDataFrame(made, "transaction_id long, customer_id long, transaction_ts timestamp, amount double, transaction_status string, is_cross_border boolean, is_high_risk_merchant boolean, is_risky_device boolean, is_nighttime_transaction boolean")


def test_stream_in_pieces_with_late_rows(spark, tmp_path):
    base = f"file://{tmp_path}"
    pick = random.Random(3)
    rows = [(i, pick.randrange(4), pick.choice([0, 0, 1]) + i / 4, i) for i in range(120)]
    pieces = [rows[:50], rows[50:], [(1000, 99, 200, 0)], [(2000, 1, 20, 5), (2001, 1, None, 5)], [(3000, 99, 400, 0)]]
    late = 0
    for piece in pieces:
        moves(spark, piece).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(moves(spark, []).schema).parquet(f"{base}/in")
        run = live.deliver(live.past_features(stream, "2 days").writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
        late += live.late_rows(run)
        held = [op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]]
    assert late == 2  # the one row is late on both sides of the join
    assert held[-1] <= 4  # all that is older than 30 days and the watermark is gone
    names = [*features.COUNTS, *features.SPEND, *features.RATIOS]
    got = {r["transaction_id"]: [r[n] for n in names] for r in spark.read.parquet(f"{base}/out").collect()}
    batch = features.behaviour(moves(spark, rows).withColumns({"transaction_country": F.lit("x"), "merchant_id": F.lit(1), "device_id": F.lit(1)}))
    assert got == {r["transaction_id"]: [r[n] for n in names] for r in batch.collect()} | {1000: got[1000]}


def test_upsert_is_idempotent(spark, tmp_path):
    versions = []
    merge = live.upsert_latest(spark, f"file://{tmp_path}/t", ["k"], [F.desc("v")], versions.append)
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    now = lambda: sorted(map(tuple, spark.read.parquet(versions[-1]).collect()))
    merge(batch((1, 1), (1, 5), (2, 2)), 0)
    merge(batch((1, 3), (3, 1)), 1)
    assert now() == [(1, 5), (2, 2), (3, 1)]
    merge(batch((1, 3), (3, 1)), 1)
    assert now() == [(1, 5), (2, 2), (3, 1)]
    merge(batch((2, 9)), 2)
    assert now() == [(1, 5), (2, 9), (3, 1)]


# ---------------------------------------------------------------- sweeps


@pytest.mark.parametrize("span", [40, 1000, 10**6])
def test_sweep_counts_as_sets_do(spark, span):
    pick = random.Random(span)
    rows = [(i, pick.choice([1, 1, 1, 2, None]), pick.randrange(2000) if i % 9 else None, pick.choice(["a", "b", "c", None]), pick.randrange(5)) for i in range(300)]
    df = spark.createDataFrame([(i, k, None if s is None else START + timedelta(seconds=s, milliseconds=i), x, y) for i, k, s, x, y in rows], "i long, `a.k` long, t timestamp, x string, y long").withColumnRenamed("a.k", "k")
    got = {r["i"]: (r["n_x"], r["n_y"]) for r in features.distinct_counts(df, {"n_x": ("x", 30), "n_y": ("y", 17)}, "k", "t", span).collect()}
    sight = lambda k, s, n, col: len({r[col] for r in rows if r[1] == k and r[2] is not None and s - n <= r[2] <= s - 1 and r[col] is not None})
    assert got == {i: (sight(k, s, 30, 3), sight(k, s, 17, 4)) for i, k, s, _, _ in rows if s is not None}


def test_sweep_of_a_hot_customer(spark):
    """A million rows of one customer: sets would be rows times frame."""
    rows = spark.range(300_000).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("t"), (F.col("id") % 5000).alias("x"))
    found = features.distinct_counts(rows, {"n": ("x", features.MONTH)}, "k", "t").agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert tuple(found) == (5000, 300_000, sum(min(i, 5000) for i in range(300_000)))


# ---------------------------------------------------------------- layouts


def test_morton_code_and_ranks(spark):
    df = spark.createDataFrame([(i, f"n{i:03}", None if i == 7 else i * 2.5) for i in range(64)], "a int, b string, c double")
    ranked, ranks = layout.quantile_ranks(df, ["a", "b", "c"], 3)
    got = ranked.select("a", *[ranks[c].alias(f"r_{c}") for c in "abc"], layout.morton([ranks["a"], ranks["b"]], 3).alias("z")).orderBy("a").collect()
    assert [r["r_a"] for r in got] == sorted(r["r_a"] for r in got) and {r["r_a"] for r in got} == set(range(8))
    assert all(abs(r["r_a"] - r["r_b"]) <= 1 for r in got) and got[7]["r_c"] == 0
    for r in got:
        assert r["z"] == sum((r["r_a"] >> b & 1) << (2 * b + 1) | (r["r_b"] >> b & 1) << (2 * b) for b in range(3))


def test_zorder_skips_on_both_columns_and_sorting_on_one(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("x"), (F.col("id") * 104_729 % 20_011).alias("y"), F.lit("k").alias("same"))
    layout.overwrite_zordered(df, f"{base}/z", ["x", "y"], 64)
    tables.overwrite_clustered(df, f"{base}/s", ["x", "y"], 64)
    assert spark.read.parquet(f"{base}/z").exceptAll(df).count() == 0 and spark.read.parquet(f"{base}/z").count() == 20_000
    most = {}
    for name in "zs":
        ranges = layout.file_ranges(spark, f"{base}/{name}", ["x", "y"])
        for c in "xy":
            most[name + c] = layout.touched(ranges, c, layout.even_ranges(df, c, 16)).agg(F.max(F.size("files"))).first()[0]
    assert most["sx"] <= 6 and most["sy"] == 64 and most["zx"] <= 24 and most["zy"] <= 24


def test_zorder_of_odd_tables(spark, tmp_path):
    base = f"file://{tmp_path}"
    hot = spark.createDataFrame([(None if i % 3 == 0 else 5, "s") for i in range(300)], "`a b` int, _code string")
    layout.overwrite_zordered(hot, f"{base}/hot", ["a b", "_code"], 4)
    assert spark.read.parquet(f"{base}/hot").groupBy("a b").count().count() == 2


def test_colocated_tables_need_no_shuffle(spark, tmp_path):
    from tidemark import queries_scale as qs

    tx = fx.event_transactions(spark, TINY).select("transaction_id", "customer_id", "transaction_ts")
    layout.bucketed(tx, "tidemark_test_tx", f"file://{tmp_path}/tx", "customer_id", 4, ["transaction_ts"])
    layout.bucketed(tables.load(spark, TINY, "labels").select(F.col("doc_id").alias("customer_id"), F.col("toxic").alias("fraud_label")), "tidemark_test_labels", f"file://{tmp_path}/l", "customer_id", 4, [])
    found = qs.colocated(spark, "tidemark_test")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "SortMergeJoin" in plan
    assert found.count() == tx.count()


# ---------------------------------------------------------------- vectors


def test_search_is_exact_with_hot_cells_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 50)
    pick = random.Random(1)
    rows = [(i, [pick.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(150)] + [(5000, None), (5001, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors.build_index(df, path := f"file://{tmp_path}/i", cells=8)
    got = vectors.search(spark, path, df.where("vec_id % 20 = 0"), k=4, probes=1).orderBy("query", "rank").collect()
    import math

    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows if v and any(v)}
    want = []
    for q in sorted(i for i in unit if i % 20 == 0):
        scored = sorted((-round(sum(a * b for a, b in zip(unit[q], v)), 6), i) for i, v in unit.items())[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert [(r["query"], r["rank"], r["key"]) for r in got] == [w[:3] for w in want]
    assert all(abs(r["score"] - w[3]) < 2e-6 for r, w in zip(got, want))
    near = vectors.search(spark, path, df.where("vec_id % 20 = 0"), k=4, probes=1, exact=False)
    found = vectors.recall(near, vectors.search(spark, path, df.where("vec_id % 20 = 0"), k=4)).first()
    assert found["queries"] == len({w[0] for w in want}) and 0 < found["recall"] <= 1


# ---------------------------------------------------------------- text search and investigations


CHUNKS = [("c1", "Gambling and crypto payments; gambling is high risk"), ("c2", "Cross-border payments above the limit"), ("c3", None), ("c4", "")]


def test_bm25_by_hand(spark):
    import math

    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, chunk_text string")
    asked = spark.createDataFrame([("GAMBLING payments gambling",), ("GAMBLING payments gambling",), ("nothing here",), (None,)], "query_text string")
    got = [tuple(r) for r in search.bm25_top_k(chunks, asked, 3).orderBy("rank").collect()]
    mean, idf = (8 + 6) / 4, lambda df: math.log((4 - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    want = [(1, "c1", 2 * idf(1) * part(2, 8) + idf(2) * part(1, 8)), (2, "c2", idf(2) * part(1, 6))]
    assert [g[:3] for g in got] == [("GAMBLING payments gambling", r, k) for r, k, _ in want]
    assert all(abs(g[3] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_investigations_in_one_plan_and_their_audit(spark, tmp_path):
    facts = spark.createDataFrame([(1, 5.0, "GAMBLING", "US", True, 4), (2, 20_000.0, "GROCERY", "FR", True, 1)], "transaction_id long, amount double, merchant_category string, transaction_country string, is_cross_border boolean, risk_signal_count int")
    asked = spark.createDataFrame([("1",), ("2",), ("2",), ("7",), ("x",), (None,), ("",)], "transaction_id string")
    found = search.investigate_all(asked, facts, spark.createDataFrame(CHUNKS, "chunk_id string, chunk_text string"))
    rows = {r["transaction_id"]: r for r in found.collect()}
    assert found.count() == 7 and {k for k, r in rows.items() if r["found"]} == {"1", "2"}
    assert rows["1"]["answer"].endswith("action: ESCALATE_TO_TIER2") and rows["1"]["policy_keys"].startswith("c1") and "Gambling" in rows["1"]["prompt"]
    assert rows["2"]["answer"].endswith("action: FILE_SAR")
    for k in ("7", "x", None, ""):
        assert rows[k]["answer"] == retrieval.REFUSAL and "(transaction not found)" in rows[k]["prompt"]
    audit = search.audit_rows(found, F.lit("2026-01-01").cast("timestamp"))
    tables.append(audit, f"file://{tmp_path}/audit", audit.schema)
    assert retrieval.recent(spark.read.parquet(f"file://{tmp_path}/audit"), 10).count() == 7


# ---------------------------------------------------------------- marts


def facts(spark, days):
    return spark.createDataFrame(
        [(i, START.date() + timedelta(days=d) if d is not None else None, "US" if i % 2 else None, "FR", "C", i % 3, "m", "X", "LOW", i % 24, "MOBILE", True, False, 0.1 * i, i % 2 == 0, i % 2) for i, d in days],
        "transaction_id long, event_date date, transaction_country string, home_country string, merchant_category string, merchant_id long, merchant_name string, merchant_country string, merchant_risk_level string, transaction_hour int, device_type string, rooted_device_flag boolean, emulator_flag boolean, amount double, is_cross_border boolean, suspected_fraud_flag int",
    )


MAKE = {"by_country": marts.by_country, "by_category": marts.by_category, "top_merchants": lambda f: marts.top_merchants(f, 2), "by_hour": marts.by_hour, "corridor": marts.corridor, "device_profile": marts.device_profile, "daily": marts.daily}


def same(spark, parts, fact):
    for name, make in MAKE.items():
        one, other = marts.mart_of(parts, name, 2), make(fact)
        assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect())), name


def test_all_marts_from_one_scan(spark):
    fact = facts(spark, [(i, i % 4 if i % 11 else None) for i in range(60)])
    parts = marts.partials(fact)
    same(spark, parts, fact)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Aggregate") == 1


def test_deliveries(spark, tmp_path):
    out = f"file://{tmp_path}/m"
    one, two = facts(spark, [(i, i % 3) for i in range(30)]), facts(spark, [(100 + i, 2 + i % 2 if i % 5 else None) for i in range(20)])
    assert incremental.deliver(spark, one, out, "a") == ["2024-01-01", "2024-01-02", "2024-01-03"]
    import shutil

    # what a delivery doesn't touch isn't read: it may be gone
    shutil.move(f"{tmp_path}/m/facts/period=2024-01-01", f"{tmp_path}/away")
    assert incremental.deliver(spark, two, out, "b") == ["2024-01-03", "2024-01-04", "none"]
    incremental.deliver(spark, two, out, "b")
    same(spark, incremental.all_sums(spark, out), one.unionByName(two))
    incremental.publish(spark, out)
    assert spark.read.parquet(f"{out}/gold/daily").count() == 5
    assert "PartitionFilters: [isnotnull" in incremental.facts_of(spark, out, ["2024-01-03"])._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [cast", "PartitionFilters: [isnotnull")


def test_observed_counts_must_add_up(spark, tmp_path):
    bad = [{"total_bronze_records": 2, "clean_records": 2, "quarantined_records": 0}, {"total_bronze_records": 1, "clean_records": 0, "quarantined_records": 1}]
    assert quality.summary_of(spark, bad, 3).first()["clean_records"] == 2
    with pytest.raises(ValueError):
        quality.summary_of(spark, bad, 4)
    seen = Observation()
    rows = tables.side_session(spark).range(5).withColumns({"quarantine_reason": F.lit(None).cast("string"), "dedup_rn": F.lit(1), **{f: F.col("id") > 2 for f in quality.FLAGS}})
    quality.observed(rows, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["total_bronze_records"] == 5 == seen.get["clean_records"] and seen.get["late_arriving_count"] == 2


# ---------------------------------------------------------------- skew


def test_skewed_join(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 50).cast("long").alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    hot = enrich.hot_keys(rows, "k", 0.1)
    assert [tuple(r) for r in hot.collect()] == [(7, 1333 + rows.where("k = 7 and id % 3 = 0").count())]
    want = sorted(map(str, rows.join(dim, "k", "left").select("id", "k", "name").collect()))
    got = enrich.skewed_join(rows, dim, "k", hot, per_task=100)
    assert sorted(map(str, got.select("id", "k", "name").collect())) == want
    assert sorted(map(str, enrich.skewed_join(rows, dim, "k", hot.where("false")).select("id", "k", "name").collect())) == want


def test_zorder_files_are_whole_cells():
    assert layout.cell_files({p: 10 for p in range(64)}, 6, 16) == [(4 * i, 4 * i + 4, 1) for i in range(16)]
    assert layout.cell_files({0: 1, 9: 700, 15: 100}, 4, 8) == [(0, 12, 7), (12, 16, 1)]
    assert sum(files for _, _, files in layout.cell_files({}, 3, 4)) == 4


def test_zorder_touches_few_files_whatever_is_sampled(spark):
    from tidemark import queries_scale as qs

    found = qs.zorder_skipping(spark, "/root/testdata/sf0.1").collect()
    assert len(found) == 16 and all(r["few"] for r in found)


def test_search_multiplies_pieces_by_blocks(spark, tmp_path, monkeypatch):
    """The same neighbours whatever the pieces, blocks and steps; copies that tie at the k-th place are told by key."""
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 1) for _ in range(5)]) for i in range(150)] + [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "PIECE", 20)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    vectors.build_index(df, path := f"file://{tmp_path}/i", cells=4)
    found = vectors.search(spark, path, df.where("vec_id % 20 = 0"), k=5, probes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["key"])
    assert got[200] == got[220] == [200, 201, 202, 203, 204] and len(got) == 10 and all(len(v) == 5 and v[0] == q for q, v in got.items() if q < 200)


def test_searched_rows_are_not_shuffled(spark):
    """Queries are dealt by text once, and rows that ask few texts not at all."""
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, chunk_text string")
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "crypto payments").otherwise("the limit").alias("query_text"))
    scored = search.bm25_top_k(chunks, rows)
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    met = search.with_context(rows, chunks)
    assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    assert {(r[0], r[1]) for r in met.select("query_text", F.col("policy")[0]["key"]).distinct().collect()} == {("crypto payments", "c1"), ("the limit", "c2")}


def test_deliveries_join_the_facts_once(spark, monkeypatch):
    from tidemark import queries_scale as qs

    wrote, keep = [], tables.overwrite
    monkeypatch.setattr(tables, "overwrite", lambda df, path, by=(): (wrote.append(df.columns), keep(df, path, by)))
    monkeypatch.setattr(qs.incremental, "deliver", lambda spark, facts, *a: wrote.append(facts._jdf.queryExecution().optimizedPlan().toString().count("Join")))
    monkeypatch.setattr(qs.incremental, "all_sums", lambda spark, path: marts.merged(marts.partials(facts(spark, [(1, 0)]))))
    qs.marts_by_delivery(spark, TINY)
    assert wrote[1:] == [0, 0, 0] and len(wrote[0]) == 16


def test_sweep_deals_rows_once(spark):
    """One exchange and no join, whatever is counted; rows of two spans see each other."""
    rows = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 50_000).alias("t"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("y"))
    found = features.distinct_counts(rows, {"n": ("x", features.MONTH), "m": ("y", features.WEEK)}, "k", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    sets = lambda c, n: F.size(F.collect_set(c).over(Window.partitionBy("k").orderBy(F.unix_timestamp("t")).rangeBetween(-n, -1))).cast("long")
    want = rows.select("*", sets("x", features.MONTH).alias("n"), sets("y", features.WEEK).alias("m"))
    assert found.exceptAll(want).count() == 0 and found.count() == 4000


def test_features_by_batch_with_late_and_replayed_rows(spark, tmp_path):
    """The same features as of the whole, final by the watermark; a batch that comes again changes nothing; nothing is paired."""
    pick = random.Random(5)
    rows = [(i, pick.randrange(4), pick.choice([0, 0, 1]) + i / 4, i) for i in range(200)]
    pieces = [rows[:50], rows[50:90], [*rows[90:], (5000, 2, None, 1), (5001, None, 30, 1)], [(1000, 99, 200, 0)], [(2000, 1, 20, 5), (2001, 1, 197.5, 5)], [(3000, 99, 400, 0)]]
    merge = live.behaviour_by_batch(spark, f"file://{tmp_path}/t", 2 * features.DAY)
    for n, piece in enumerate(pieces):
        merge(moves(spark, piece), n)
        if n in (0, 2, 4):
            merge(moves(spark, piece), n)
    names = [*features.COUNTS, *features.SPEND, *features.RATIOS]
    found = spark.read.parquet(f"file://{tmp_path}/t/features")
    got = {r["transaction_id"]: [r[n] for n in names] for r in found.collect()}
    held = rows + [(1000, 99, 200, 0)]
    batch = features.behaviour(moves(spark, held), distinct=False)
    assert got == {r["transaction_id"]: [r[n] for n in names] for r in batch.collect()} and found.count() == len(held)


def test_live_features_pair_no_rows(spark, monkeypatch):
    from tidemark import queries_scale as qs

    held = []
    monkeypatch.setattr(qs.live, "deliver", lambda writer, checkpoint, run=live.deliver: held.extend(op for p in run(writer, checkpoint).recentProgress for op in p["stateOperators"]))
    assert qs.live_features(spark, TINY).count() == 1000 and not held


def test_facts_shuffle_no_lines_by_customer_and_no_texts(spark):
    """Where no dimension is small enough to send: customers meet orders, and the lines' texts are made after their shuffles."""
    import re

    from tidemark import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.enrich_signals(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#.*\n.*?Project \[(.*)\]", plan)
    lines = {key for key, columns in dealt if "l_extendedprice" in columns or "amount#" in columns}
    assert lines == {"device_id", "l_orderkey", "merchant_id"} and {"customer_id"} < {key for key, _ in dealt}
    assert not any(name in columns for _, columns in dealt for name in ("payment_type", "transaction_country"))


def test_skewed_enrichment_makes_its_rows_once(spark):
    """The joins before it are not made again for each key's counts; the hot keys of all columns come from one sketch."""
    from tidemark import queries_scale as qs

    plan = qs.enrich_skewed(spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "o_custkey" not in plan
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("a"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 4).alias("b"), F.col("id").alias("c"))
    found = enrich.hot_keys_of(rows, ["a", "b", "c"], 0.2)
    assert sorted(map(tuple, found.collect())) == [("a", 7, 501), *(("b", k, 200) for k in range(4))]


def test_investigations_join_the_facts_once(spark):
    """One row an id is written; neither the joins nor a cached copy of them stand in the plan of the answers."""
    from tidemark import queries_scale as qs

    plan = qs.investigate_all(spark, TINY)._jdf.queryExecution()
    assert "InMemoryRelation" not in plan.withCachedData().toString() and "l_extendedprice" not in plan.optimizedPlan().toString()
