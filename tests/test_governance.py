"""Drift, scores, learning, chains, exposure, masks and picks on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from datavigil.functions import masking as M
from datavigil.functions import similarity as Y
from datavigil.operators import audit as U
from datavigil.operators import discovery as V
from datavigil.operators import feedback as B
from datavigil.operators import grouping as G
from datavigil.operators import lineage as L
from datavigil.streaming import streams as W

FACT = "source string, classification string, asset_count int, finding_count int, sensitivity_avg double"


@pytest.mark.parametrize("prior, current, kinds", [
    ([], [], set()),
    ([], [("s1", "SSN", 10, 50, 80.0)], {"asset_added"}),
    ([("s1", "EMAIL", 5, 20, 30.0)], [], {"asset_removed"}),
    ([("s1", "SSN", 1, 100, 50.0)], [("s1", "SSN", 1, 200, 50.0)], {"finding_count_spike"}),
    ([("s1", "SSN", 1, 100, 50.0)], [("s1", "SSN", 1, 140, 50.0)], set()),
    ([("s1", "SSN", 1, 10, 30.0)], [("s1", "SSN", 1, 10, 60.0)], {"risk_increased"}),
    ([("s1", "SSN", 1, 10, 80.0)], [("s1", "SSN", 1, 10, 50.0)], {"risk_decreased"}),
    ([("s1", "SSN", 1, 10, 50.0)], [("s1", "SSN", 1, 10, 50.0), ("s2", "EMAIL", 5, 30, 20.0)], {"asset_added"}),
    ([("s1", "SSN", 1, 0, 50.0)], [("s1", "SSN", 1, 11, 50.0)], {"finding_count_spike"}),
])
def test_drift(spark, prior, current, kinds):
    events = V.drift(spark.createDataFrame(prior, FACT), spark.createDataFrame(current, FACT))
    assert {r.event_type for r in events.collect()} == kinds


@pytest.mark.parametrize("rows, weights, want", [
    ([(0, 50)], {}, 100.0), ([(10, 100)], {}, 1710.0), ([(-5, -10)], {}, 0.0), ([(1, 10), (2, 20)], {}, 138.0),
    ([(10, 50)], {"volume": 0.5, "sensitivity": 1.0, "exposure": 0.5}, 305.0),
])
def test_composite_score(spark, rows, weights, want):
    df = spark.createDataFrame([(1, n, s) for n, s in rows], "asset_id int, finding_count int, sensitivity int")
    assert float(V.composite_score(df, **weights).first().score) == want


def test_fuzzy_matching_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    near = [w[:-1] + rng.choice("abcd") if len(w) > 3 else w for w in words]
    near += [w[:2] + "x" + w[2:] for w in words[:40]]
    keys = (1, 1, "p", "T")
    learned = spark.createDataFrame(
        [(f"l{i}", *keys, f"a.f{i % 3}", w) for i, w in enumerate(words)],
        "learned_id string, tenant_id int, asset_id int, pattern_name string, pii_type string, field_path string, matched_value string")
    cells = spark.createDataFrame(
        [(*keys, f"b.f{i % 3}", w) for i, w in enumerate(near)],
        "tenant_id int, asset_id int, pattern_name string, pii_type string, field_path string, matched_value string").distinct()
    got = {(r.field_path, r.matched_value, r.learned_id) for r in B._similar_pairs(cells, learned).collect()}
    pairs = cells.crossJoin(learned.select("learned_id", F.col("field_path").alias("_p"), F.col("matched_value").alias("_v")))
    want = pairs.filter(Y.overall("_p", "field_path", "_v", "matched_value") >= Y.MIN_SIMILARITY)
    assert got == {(r.field_path, r.matched_value, r.learned_id) for r in want.collect()}
    assert len(got) > 50


def test_match_types(spark):
    learned = spark.createDataFrame([("l", 1, 1, "mail", "email", "user.email", "test@example.com")],
                                    "learned_id string, tenant_id int, asset_id int, pattern_name string, pii_type string, field_path string, matched_value string")
    found = spark.createDataFrame([
        ("a", 1, 1, "mail", "email", "user.email", "test@example.com"), ("b", 1, 1, "mail", "email", "user.email", "other@domain.com"),
        ("c", 1, 1, "mail", "email", "user.email", "test@example.co"), ("d", 1, 1, "mail", "email", "user.email", "zzz@nowhere.org"),
        ("e", 1, 2, "mail", "email", "user.email", "test@example.com")],
        "finding_id string, tenant_id int, asset_id int, pattern_name string, pii_type string, field_path string, matched_value string")
    assert {r.finding_id: r.match_type for r in B.fp_match(found, learned).collect()} == {
        "a": "exact", "b": "pattern", "c": "fuzzy"}
    assert {r.finding_id for r in B.suppress(found, learned).collect()} == {"d", "e"}


def test_findings_meet_few_learned_values_as_arrays_and_many_by_keys(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 9)))
    paths = ["a.f", "b.f", "b.g", None]
    kinds = ["T", "email", None]
    learned = [(f"l{i}", 1, rng.choice([1, 2, 2, 2, 2, 3, None]), "p", rng.choice(kinds), rng.choice(paths), rng.choice([None, *[word()] * 30]))
               for i in range(300)]
    found = [(rng.choice([None, f"f{i}", "same"]) if i % 9 == 0 else f"f{i}", 1, rng.choice([1, 2, 3, 4, None]), "p", rng.choice(kinds),
              rng.choice(paths), rng.choice([None, *[word()] * 30])) for i in range(500)]
    found += [(f"e{i}{tail}", *r[1:-1], r[-1] and r[-1] + tail) for i, r in enumerate(learned) for tail in ("", "!", "?!")]
    learned += [(f"k{i}", *r[1:]) for i, r in enumerate(learned) if i % 7 == 0]  # the same value once more
    fields = ", tenant_id int, asset_id int, pattern_name string, pii_type string, field_path string, matched_value string"
    known, rows = spark.createDataFrame(learned, "learned_id string" + fields), spark.createDataFrame(found, "finding_id string" + fields)
    sizes = {r["n"] > B.FEW for r in known.groupBy(*B.LEARNED_KEYS).agg(F.count_distinct("field_path", "matched_value").alias("n")).collect()}
    assert sizes == {True, False}
    once = B.pick_first(known, B._SPOT, "learned_id")
    want = sorted(map(tuple, B._indexed(rows, once).collect()), key=repr)
    got = sorted(map(tuple, B.fp_match(rows, known).collect()), key=repr)
    assert got == want and {r[3] for r in got} == {"exact", "pattern", "fuzzy"}
    kept = rows.join(B._indexed(rows, once), "finding_id", "left_anti")
    assert sorted(map(tuple, B.suppress(rows, known).collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)
    # where all keys have few, no finding is shuffled by its value and no pair is
    few, _ = B._judged(rows, known.filter("asset_id = 3"))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan


def _events(spark, n=200):
    rows = [(i, i % 3, "act", "asset", str(i % 5), '{"k":1}', f"2024-01-0{1 + i // 80} 10:{i % 60:02d}:00") for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, tenant_id long, action string, resource_type string, resource_id string,"
                                 " metadata string, at string").withColumn("event_time", F.col("at").cast("timestamp_ntz"))


def test_chain_verifies_and_names_forged_entries(spark):
    events = _events(spark)
    chain = U.build_chain(events).persist()
    assert U.verify_chain(chain, events).filter("NOT hash_ok OR NOT link_ok").count() == 0
    forged = events.withColumn("metadata", F.when(F.col("event_id") == 42, "{}").otherwise(F.col("metadata")))
    assert [r.event_id for r in U.verify_chain(chain, forged).filter("NOT hash_ok").collect()] == [42]
    dropped = chain.filter("event_id <> 60")
    assert U.verify_chain(dropped, events).filter("NOT link_ok").count() == 1
    assert U.seal_chain(chain).exceptAll(U.seal_chain(dropped)).count() == 1


def test_appended_batches_make_one_chain(spark):
    events = _events(spark)
    none = spark.createDataFrame([], "tenant_id long, entry_hash string")
    first = U.build_chain(events.filter("event_id < 90"), heads=none)
    heads = U.chain_heads(first).select("tenant_id", "entry_hash")
    second = U.build_chain(events.filter("event_id >= 90 AND event_id < 200"), heads=heads)
    got = {r.event_id: r.entry_hash for r in first.unionByName(second).collect()}
    want, rows = {}, sorted(events.collect(), key=lambda r: (r.tenant_id, r.event_id >= 90, r.event_time, r.event_id))
    last = {}
    for r in rows:
        text = "|".join([last.get(r.tenant_id, "genesis"), r.action, r.resource_type, r.resource_id, r.metadata,
                         r.event_time.strftime("%Y-%m-%dT%H:%M:%SZ")])
        last[r.tenant_id] = want[r.event_id] = hashlib.sha256(text.encode()).hexdigest()
    assert got == want


def test_appended_batches_verify_and_a_lost_batch_shows(spark):
    events = _events(spark)
    chain = U.build_chain(events.filter("event_id < 60"))
    for name, when in (("x1", "event_id >= 60 AND event_id < 90"), ("x2", "event_id >= 90")):
        chain = chain.unionByName(U.build_chain(events.filter(when), heads=U.tenant_heads(chain), batch=name))
    chain.persist()
    assert chain.count() == events.count()
    assert U.verify_chain(chain, events).filter("NOT hash_ok OR NOT link_ok").count() == 0
    lost = U.verify_chain(chain.filter("segment <> 'x1'"), events).filter("NOT link_ok")
    assert {r.segment for r in lost.collect()} == {"x2"}


def test_exposure_window_closed_in_the_middle(spark):
    seen = spark.createDataFrame([(1, "T", s, f"2024-01-0{s} 00:00:00") for s in (1, 2, 4, 5)],
                                 "asset_id int, pii_type string, scan_run_id int, at string").withColumn(
        "created_at", F.col("at").cast("timestamp_ntz"))
    closed = spark.createDataFrame([(1, "T", "2024-01-03 12:00:00"), (2, "T", "2024-01-03 12:00:00")],
                                   "asset_id int, pii_type string, at string").withColumn(
        "closed_at", F.col("at").cast("timestamp_ntz"))
    rows = L.exposure_windows(seen, closed).orderBy("since").collect()
    assert [(r.first_scan_id, r.last_scan_id, r.until is None, r.duration_hours) for r in rows] == [
        (1, 2, False, 60), (4, 5, True, None)]


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 5), (6, 1)],
                                  "source_asset_id int, target_asset_id int")
    assert [r.path for r in L.find_cycles(edges).collect()] == [[1, 2], [2, 3, 4]]


def test_masks_never_return_the_value(spark):
    values = ["ABCPE1234F", "user@mail.com", "4111111111111111", "9876543210", "234123412346", "SBIN0001234", "10.1.2.3"]
    types = list(M.TYPED)
    rows = [(v, t) for v in values for t in types if t not in ("IN_AADHAAR", "IN_PAN", "IN_IFSC", "IP_ADDRESS", "US_SSN")]
    df = spark.createDataFrame(rows, "v string, t string")
    same = df.filter((M.mask_typed("v", "t") == F.col("v")) | (M.partial("v", "t") == F.col("v")) | (M.token("v") == F.col("v")))
    assert same.count() == 0


def test_picks_and_upsert(spark):
    rows = spark.createDataFrame([(k, v, f"x{v}") for k in ("hot", "cold") for v in range(50)], "k string, v int, x string")
    assert {(r.k, r.x) for r in G.pick_latest(rows, ["k"], "v").collect()} == {("hot", "x49"), ("cold", "x49")}
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, at int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "new")], "k string, at int, x string")
    assert {(r.k, r.x) for r in G.upsert(old, new, ["k"], "at").collect()} == {("a", "new"), ("b", "old"), ("c", "new")}


def test_earlier_count_over_a_hot_key(spark):
    rows = spark.range(300).selectExpr("id", "IF(id % 3 = 0, 'hot', 'k' || id % 7) AS k", "id DIV 50 AS day")
    got = {r.id: r.n for r in G.earlier_count(rows, ["k"], F.col("day"), "id", name="n").collect()}
    seen, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        want[r.id] = seen.get(r.k, 0)
        seen[r.k] = want[r.id] + 1
    assert got == want


def test_refused_steps_keep_the_state(spark):
    events = spark.createDataFrame(
        [(1, i, s, "2024-01-01") for i, s in enumerate(["completed", "running", "pending", "failed", "running"])],
        "scan_run_id long, seq long, status string, d string").withColumn("at", F.col("d").cast("timestamp_ntz"))
    rows = W.transitions(events).orderBy("seq").collect()
    assert [(r.from_status, r.allowed) for r in rows] == [
        ("pending", False), ("pending", True), ("running", False), ("running", True), ("failed", False)]


def plain_cycles(edges, most=10):
    out, nexts = set(), {}
    for a, b in edges:
        if a != b:
            nexts.setdefault(a, set()).add(b)

    def walk(path):
        for n in nexts.get(path[-1], ()):
            if n == path[0] and len(path) > 1:
                out.add(tuple(path))
            elif n > path[0] and n not in path and len(path) < most:
                walk([*path, n])

    for v in nexts:
        walk([v])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(45)] + [(i, i + 1) for i in range(100, 112)] + [(112, 100), (111, 102)]
    frame = spark.createDataFrame(edges, "source_asset_id bigint, target_asset_id bigint")
    got = [tuple(r.path) for r in L.find_cycles(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cycles(edges)
    assert [len(p) for p in got] == sorted(len(p) for p in got) and len(L.find_cycles(frame, limit=2).collect()) == min(2, len(got))


def test_cycles_with_a_hub(spark):
    hub = [(0, i) for i in range(1, 10_001)] + [(i, 0) for i in range(1, 5_001)] + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (0, 20_000), (5, 20_000)]
    frame = spark.createDataFrame(hub, "source_asset_id bigint, target_asset_id bigint")
    rows = L.find_cycles(frame).groupBy("length").count().collect()
    assert {r["length"]: r["count"] for r in rows} == {2: 5000, 3: 1}


def test_streams_resume_and_count_once(spark, tmp_path):
    from datavigil.streaming import ledger
    from datavigil.streaming import streams as W

    rows = spark.createDataFrame([(["a", "b", None][i % 3], f"p{i % 17}" if i % 5 else None) for i in range(300)], "data_source string, source_path string")
    for part in rows.randomSplit([1.0] * 5, 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    each, numbers = ledger.totals_of(str(tmp_path / "t")), []

    def breaks(found, batch):
        numbers.append(batch)
        each(found, batch)
        if numbers in ([0], [0, 0, 1]):
            raise RuntimeError("stopped")

    for _ in range(3):
        stream = W.stream_files(spark, str(tmp_path / "in"), rows.schema, max_files=2)
        try:
            ledger.run_batches(stream, breaks, str(tmp_path / "c")).awaitTermination()
        except Exception:  # noqa: BLE001 - the breaks above
            pass
    assert numbers == [0, 0, 1, 1, 2]  # five files, two a batch; broken batches come again with their numbers
    got = {r["data_source"]: (r["findings"], r["records"], r["windows"]) for r in ledger.read_totals(spark, str(tmp_path / "t")).collect()}
    want = {r["data_source"]: (r["n"], r["d"]) for r in rows.groupBy("data_source").agg(F.count("*").alias("n"), F.count_distinct("source_path").alias("d")).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and all(1 <= v[2] <= 3 for v in got.values())


def test_life_cycle_batches_resume(spark, tmp_path):
    from datavigil.streaming import ledger
    from datavigil.streaming import streams as W

    rng = random.Random(5)
    steps = [(s, q, rng.choice(list(W.TRANSITIONS)), q * 10 + rng.randint(0, 3)) for q in range(6) for s in range(40) if rng.random() < 0.8]
    each, schema = ledger.life_cycle_of(spark, str(tmp_path), 8), "scan_run_id bigint, seq bigint, status string, at bigint"
    for batch in range(3):
        own = spark.createDataFrame([s for s in steps if s[1] // 2 == batch], schema)
        each(own, batch)
        if batch == 1:
            each(own, batch)  # handed out again
    got = {(r["scan_run_id"], r["seq"]): (r["from_status"], r["allowed"]) for r in ledger.read_steps(spark, str(tmp_path)).collect()}
    state, want = {}, {}
    for s, q, wanted, at in sorted(steps, key=lambda x: (x[1] // 2, x[3], x[1])):
        now = state.get(s, "pending")
        ok = wanted in W.TRANSITIONS[now]
        want[s, q] = (now, ok)
        state[s] = wanted if ok else now
    assert got == want


def test_policy_that_cannot_be_read_leaves_the_others(spark):
    from datavigil.operators import policy as O

    found = spark.createDataFrame([(1, "EMAIL", "High", 50)], "finding_id bigint, pii_type string, severity string, risk_score int")
    bad = [{"id": i, "name": "x", "conditions": c, "actions": "[]"} for i, c in enumerate(['{"min_risk_score": "high"}', "[1]", "{", None, '{"min_risk_score": null}', "7"])]
    rows = O.evaluate_policies(found, [*bad, {"id": 99, "name": "ok", "conditions": '{"min_risk_score": 10}', "actions": "[]"}]).collect()
    assert [r["policy_id"] for r in rows] == ["99"]


def test_audit_batches_must_follow(spark):
    from datavigil.operators import audit as U

    events = spark.sql("SELECT 1L AS tenant_id, id AS event_id, 'a' AS action, 'r' AS resource_type, 'x' AS resource_id, '' AS metadata, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS event_time FROM range(3)")
    none = spark.createDataFrame([], "tenant_id bigint, entry_hash string, last_seq bigint")
    chain = U.build_chain(events, heads=none, batch="2024-02")
    heads = U.tenant_heads(chain)
    assert U.build_chain(events, heads=heads, batch="2024-03").count() == 3
    for late in ("2024-01", "2024-02"):
        with pytest.raises(ValueError):
            U.build_chain(events, heads=heads, batch=late)
