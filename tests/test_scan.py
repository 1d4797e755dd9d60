import pytest
from pyspark.sql import functions as F

from twinmark.functions import vocab
from twinmark.functions.attributes import enrich
from twinmark.operators import blocking, classic, evaluation, evidence, groups, results, reuse, similarity, validation
from twinmark.plans import service
from twinmark.plans.part_master import MIXED, part_master
from twinmark.plans.scan import run_scan, run_stored_scan
from twinmark.sources import export, ingest
from twinmark.sources.store import Store


def scan(spark, a, b, engine, fields=("CONTRACT", "UNIT_MEAS"), mode=None):
    base = {"CONTRACT": "S1", "UNIT_MEAS": "PCS"}
    rows = [{**base, "PART_NO": "P-ONE", **a}, {**base, "PART_NO": "P-TWO", **b}]
    found = run_scan(ingest.from_records(spark, rows), list(fields), engine=engine, mode=mode, threshold=0, statuses=list(vocab.STATUSES)).candidates.collect()
    assert len(found) == 1
    return found[0]


CASES = [
    ({"PART_NO": "DEC CO1", "DESCRIPTION": "Decicated Coconut type 1"}, {"PART_NO": "DEC C01", "DESCRIPTION": "Dec Coco 1"}, vocab.DUPLICATE, vocab.DUPLICATE),
    ({"DESCRIPTION": "MCB 20A"}, {"DESCRIPTION": "MCB30A"}, vocab.RELATED, vocab.RELATED),
    ({"DESCRIPTION": "red paint"}, {"DESCRIPTION": "blue paint"}, vocab.RELATED, vocab.RELATED),
    ({"DESCRIPTION": "generator fuel filter"}, {"DESCRIPTION": "generator air filter"}, vocab.RELATED, vocab.RELATED),
    ({"DESCRIPTION": "coconut type 1"}, {"DESCRIPTION": "coconut type 2"}, vocab.RELATED, vocab.RELATED),
    ({"DESCRIPTION": "steel pipe", "HSN_SAC_CODE": "7306"}, {"DESCRIPTION": "steel pipe", "HSN_SAC_CODE": "3917"}, vocab.CONFLICT, vocab.CONFLICT),
]


@pytest.mark.parametrize("a, b, evidence, classic", CASES)
def test_decisions(spark, a, b, evidence, classic):
    assert scan(spark, a, b, "evidence").business_status == evidence
    assert scan(spark, a, b, "classic").business_status == classic


def test_classic_scores_and_texts(spark):
    row = scan(spark, CASES[1][0], CASES[1][1], "classic")
    assert row.similarity_score == 55 and row.explanation == "Both are MCB items, but ampere rating differs: 20A vs 30A." and row.tfidf_score == 0
    row = scan(spark, CASES[0][0], CASES[0][1], "classic")
    assert row.similarity_score == 100 and row.confidence_level == "HIGH"
    row = scan(spark, {"DESCRIPTION": "steel pipe", "UNIT_MEAS": "g"}, {"DESCRIPTION": "steel pipe"}, "classic", fields=())
    assert row.similarity_score == 45 and row.confidence_level == "IGNORE" and "Inventory UOM differs" in row.explanation
    row = scan(spark, {"DESCRIPTION": "Labels"}, {"DESCRIPTION": "Warning labels"}, "classic")
    assert row.business_status == vocab.INSUFFICIENT and row.similarity_score <= 65 and row.generic_description_warning
    row = scan(spark, {"DESCRIPTION": "generator air filter"}, {"DESCRIPTION": "hvac air filter"}, "classic")
    assert row.business_status == vocab.POSSIBLE and row.similarity_score <= 78 and row.rule_decision == "DOWNGRADE"


def test_evidence_texts(spark):
    row = scan(spark, CASES[1][0], CASES[1][1], "evidence")
    assert row.rejection_reason == "rating_mismatch" and "Both are mcb items, but rating differs: 20a vs 30a." in row.explanation
    row = scan(spark, {"DESCRIPTION": "steel pipe", "SAFETY_CODE": "HZ1"}, {"DESCRIPTION": "steel pipe", "SAFETY_CODE": "HZ2"}, "evidence")
    assert row.business_status == vocab.CONFLICT and row.rejection_reason == "safety_code_mismatch"


def test_cross_site(spark):
    a, b = {"DESCRIPTION": "SS Pipe", "CONTRACT": "S1"}, {"DESCRIPTION": "Stainless Steel Pipe", "CONTRACT": "S2"}
    for engine in ("classic", "evidence"):
        row = scan(spark, a, b, engine, fields=["UNIT_MEAS"], mode="cross_site_standardization")
        assert row.business_status == vocab.CROSS_SITE
    records = ingest.from_records(spark, [{"PART_NO": "A", **a}, {"PART_NO": "B", **b}])
    assert run_scan(records, threshold=0).candidates.isEmpty()


def test_candidate_rules(spark):
    rows = [("1", "A", "steel pipe", "S1", "x"), ("2", "B", "steel pipe", "S1", ""), ("3", "a", "steel pipe", "S1", "y"), ("4", "", "steel pipe", "", "x"), ("5", "", "steel pipe", "S2", None)]
    df = enrich(spark.createDataFrame([(int(i), p, d, c, f) for i, p, d, c, f in rows], "rec_idx long, PART_NO string, DESCRIPTION string, CONTRACT string, F string"))
    pairs = lambda **o: {(r.idx_a, r.idx_b) for r in blocking.candidate_pairs(df, ["F"], **o).collect()}
    # 1 and 3 have the same part number; blanks match anything; 4 has no site
    assert pairs() == {(1, 2), (1, 4), (2, 3), (2, 4), (4, 5)}
    assert pairs(cross_site=True) == {(1, 2), (1, 4), (2, 3), (2, 4), (1, 5), (2, 5), (3, 5), (4, 5)}
    assert len(pairs(cross_site=True, most=3)) == 3
    for most, reached in ((8, True), (9, False)):
        found, said = blocking.limited_pairs(df, ["F"], cross_site=True, most=most)
        assert found.count() == 8 and [w["warning_type"] for w in said] == ["PAIR_LIMIT_REACHED"] * reached
    rows = blocking.candidate_pairs(df, ["F"], cross_site=True).collect()
    assert len(rows) == len({(r.idx_a, r.idx_b) for r in rows})
    plan = blocking.candidate_pairs(df, ["F"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_validation(spark):
    rows = [("A", "x", "mail me: a.b@c.org", None), ("A", " ", "job-1234", ""), (None, "y", "", "v")]
    df = spark.createDataFrame(rows, "PART_NO string, DESCRIPTION string, NOTE string, F string")
    said = {r.warning_type: r for r in validation.warnings(df, ["F", "GONE"]).collect()}
    assert set(said) == {"EMPTY_DESCRIPTION", "DUPLICATE_PART_NO", "MISSING_SELECTED_FIELD", "HIGH_NULL_FIELD", "POSSIBLE_EMAIL", "POSSIBLE_PROJECT_REFERENCE"}
    assert said["EMPTY_DESCRIPTION"].message.startswith("1 record(s)") and said["DUPLICATE_PART_NO"].message.startswith("2 row(s)")
    assert said["HIGH_NULL_FIELD"].message == "Selected field F is 66.7% empty." and said["MISSING_SELECTED_FIELD"].subject == "GONE"
    assert not validation.missing_required(df) and validation.missing_required(df.select("NOTE")) == ["DESCRIPTION", "PART_NO"]
    assert "POSSIBLE_EMAIL" not in {r.warning_type for r in validation.warnings(df, sensitive=False).collect()}
    assert validation.parse_fields('["a", "b "]') == ["A", "B"] == validation.parse_fields("a, b,")
    with pytest.raises(ingest.RecordError):
        validation.parse_fields("[a")


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(' part_no ,Description,PART_TYPE\n001,"pipe, 2",NA\n002,null,P\n')
    df = ingest.read_csv(spark, str(path))
    assert df.columns == ["PART_NO", "DESCRIPTION", "TYPE_CODE"]
    assert [tuple(r) for r in df.orderBy("PART_NO").collect()] == [("001", "pipe, 2", None), ("002", None, "P")]
    with pytest.raises(ingest.TooLarge):
        ingest.read_csv(spark, str(path), max_rows=1)
    with pytest.raises(ingest.TooLarge):
        ingest.read_csv(spark, str(path), max_bytes=10)
    empty = tmp_path / "e.csv"
    empty.write_text("")
    with pytest.raises(ingest.RecordError):
        ingest.read_csv(spark, str(empty))
    assert len(ingest.fingerprint(spark, str(path)).first().file_sha256) == 64


def test_groups(spark):
    shape = "idx_a long, idx_b long, contract_a string, part_no_a string, description_a string, contract_b string, part_no_b string, description_b string, similarity_score double, confidence_level string, matched_evidence array<string>, mismatched_fields array<string>, differences array<struct<type:string,feature:string>>, explanation string"
    row = lambda a, b, score, level: (a, b, "S", f"P{a}", f"item {a}", "S", f"P{b}", f"item {b}", score, level, ["F"], [], [("t", None)], "")
    df = spark.createDataFrame([row(1, 2, 88.0, "MEDIUM"), row(2, 3, 92.0, "HIGH"), row(5, 6, 65.0, "LOW"), row(7, 8, 76.0, "MEDIUM")], shape)
    got = [r.asDict(recursive=True) for r in groups.duplicate_groups(df, nested=True).orderBy("group_id").collect()]
    assert [(g["group_id"], g["part_count"], g["pair_count"], g["average_score"], g["top_score"], g["confidence_level"], g["group_name"]) for g in got] == [(1, 3, 2, 90.0, 92.0, "HIGH", "item 1"), (2, 2, 1, 76.0, 76.0, "MEDIUM", "item 7")]
    assert [p["part_no"] for p in got[0]["parts"]] == ["P1", "P2", "P3"] and [p["similarity_score"] for p in got[0]["pairs"]] == [92.0, 88.0]
    assert got[0]["matched_fields"] == ["F"] and got[0]["mismatched_fields"] == ["t"]
    parts, pairs = groups.group_rows(df)
    assert parts.count() == 5 and pairs.count() == 3 and "parts" not in groups.duplicate_groups(df).columns
    ranked = groups.numbered(spark.range(1000).selectExpr("id * 7 % 1009 as x"), "x", "n").collect()
    assert [r.n for r in sorted(ranked)] == list(range(1, 1001))
    chain = spark.range(40).selectExpr("cast(id as string) a", "cast(id + 1 as string) b")
    assert groups.components(chain).select("component").distinct().count() == 1
    assert groups.duplicate_groups(df.where("similarity_score < 70")).isEmpty()


def test_export(spark, tmp_path):
    base = {"CONTRACT": "S1", "UNIT_MEAS": "PCS"}
    rows = [{**base, "PART_NO": "P-ONE", **CASES[1][0]}, {**base, "PART_NO": "P-TWO", **CASES[1][1]}]
    df = run_scan(ingest.from_records(spark, rows), ["CONTRACT", "UNIT_MEAS"], threshold=0).candidates
    out = export.export_rows(df).first()
    assert list(out.asDict()) == list(vocab.EXPORT_COLUMNS)
    assert out.matched_fields == '["CONTRACT","UNIT_MEAS"]' and out.matched_evidence == "CONTRACT; UNIT_MEAS" and out.reason == out.explanation and out.score == "55.0"
    cells = spark.createDataFrame([("=cmd",), ("+SUM",), ("-1",), ("@x",), ("a=b",), (None,)], "x string").select(export.guarded(F.col("x"))).collect()
    assert [c[0] for c in cells] == ["'=cmd", "'+SUM", "'-1", "'@x", "a=b", ""]
    export.export_csv(df, str(tmp_path / "out"), single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_filters(spark):
    assert results.allowed_statuses("odd") == list(vocab.REVIEW_STATUSES) and results.allowed_statuses("all") == list(vocab.STATUSES)
    assert results.allowed_statuses("all", "unique_no_match, nonsense") == [vocab.UNIQUE]
    with pytest.raises(ValueError):
        results.kept(spark.range(1), 101)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.summary()["scans"] == 0
    records = ingest.from_records(spark, [{"PART_NO": "DEC CO1", "DESCRIPTION": "Dec Coco 1"}, {"PART_NO": "DEC C01", "DESCRIPTION": "Decicated Coconut type 1"}])
    scan_id = run_stored_scan(store, records, ["GONE"], name=" ", threshold=50)
    assert store.scans().first().status == "COMPLETED" and store.scans().first().name == "Duplicate scan"
    found = store.ranked_candidates(scan_id).first()
    assert store.add_feedback(scan_id, found.idx_a, found.idx_b, "UNSURE") and store.add_feedback(scan_id, found.idx_a, found.idx_b, "DUPLICATE", "r")
    assert not store.add_feedback(scan_id, -1, -2, "DUPLICATE")
    with pytest.raises(ValueError):
        store.add_feedback(scan_id, 1, 2, "MAYBE")
    now = store.candidates(scan_id).first()
    assert now.review_status == "DUPLICATE" and now.reviewed_by == "r"
    assert store.summary()["feedback"] == 2 and store.warnings(scan_id).count() == 1
    with pytest.raises(Exception):
        run_stored_scan(store, records, threshold=500)
    assert store.scans().where("status = 'FAILED'").count() == 1


def test_a_scan_without_candidates_can_be_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    scan_id = run_stored_scan(store, ingest.from_records(spark, [{"PART_NO": "A", "DESCRIPTION": "pipe"}]))
    assert store.ranked_candidates(scan_id).count() == 0 and store.summary()["candidates"] == 0
    assert store.scans().first().total_candidates == 0


def test_evaluation(spark):
    rows = [(0, "MCB30A", "MCB 30 Amp", 1), (1, "Bolt 10MM", "Bolt 12MM", 0), (2, "Bicycle tire", "Paint brush", 1)]
    scored = evaluation.score_pairs(spark.createDataFrame(rows, "pair_id long, description_a string, description_b string, expected_label int"))
    assert evaluation.metrics(scored).first().asDict() == {"tp": 1, "fp": 0, "fn": 1, "tn": 1, "precision": 1.0, "recall": 0.5, "f1_score": 0.667}
    assert evaluation.errors(scored).first().error == "FALSE_NEGATIVE"


def test_synthetic_is_fixed_by_its_seed(spark):
    a, b = (ingest.synthetic(spark, 50, seed=3) for _ in range(2))
    assert a.collect() == b.collect() and a.columns[1:4] == ["CONTRACT", "PART_NO", "DESCRIPTION"]


def test_service(spark, tmp_path):
    assert service.ping(spark)["status"] == "ok"
    store = Store(spark, str(tmp_path / "store"))
    report = service.load_test(store, 40)
    assert report["candidates_found"] > 0 and report["warnings_count"] == 0
    found = service.scan_groups(store, report["scan_id"]).collect()
    assert found and all(a.top_score >= b.top_score for a, b in zip(found, found[1:], strict=False))
    service.export_scan(store, report["scan_id"], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == report["candidates_found"]
    assert service.load_test(store, 60, most=5)["warnings_count"] == 1
    kept = service.kept_data(store)
    assert {r.table for r in kept.select("table").collect()} == {"scans", "candidates", "warnings", "feedback"} and kept.where("column = 'similarity_score'").count() == 1
    service.write_synthetic(spark, 30, str(tmp_path / "made"))
    made = ingest.read_csv(spark, str(tmp_path / "made"))
    assert made.count() == 30 and "PART_NO" in made.columns
    assert service.kept_data(store, str(tmp_path / "made")).where("table = 'input' and column like 'sha256:%'").count() >= 1
    with pytest.raises(ValueError):
        service.load_test(store, 1)


def test_pair_limit_makes_few_pairs(spark, monkeypatch):
    made, keep = {}, blocking.reused

    def counted(df, name="reused"):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    df = enrich(spark.range(400).selectExpr("id as rec_idx", "concat('P-', id) as PART_NO", "'oil filter engine' as DESCRIPTION", "'A' as CONTRACT"))
    every = {(r.idx_a, r.idx_b) for r in blocking.limited_pairs(df)[0].collect()}
    assert len(every) == 400 * 399 // 2
    monkeypatch.setattr(blocking, "reused", counted)
    found, said = blocking.limited_pairs(df, most=500)
    assert sorted((r.idx_a, r.idx_b) for r in found.collect()) == sorted(every)[:500] and said
    assert made["placed-pairs"] < len(every) / 4


def test_alike_records_are_paired_as_classes(spark):
    """120 records of which 60 are alike but for their part numbers, as are 40 others; two of the rest share a part number."""
    rows = [(k, f"P-{k}" if k < 118 else "P-X", ["oil filter engine", "air filter engine", "copper cable"][0 if k < 60 else 1 if k < 100 else 2], "S1" if k % 2 else "") for k in range(120)]
    df = enrich(spark.createDataFrame(rows, "rec_idx long, PART_NO string, DESCRIPTION string, CONTRACT string"))
    found = blocking.alike(df, reads=["DESCRIPTION"])
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and ((a[0] < 100) == (b[0] < 100))}
    for ordered in (False, True):
        pairs = (found.ordered() if ordered else found.pairs)
        assert pairs.count() < 50
        got = [(r.idx_a, r.idx_b) for r in found.all_pairs(pairs, ordered).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    assert found.sized(found.pairs).agg(F.sum("n_pairs")).first()[0] == len(wanted)


def test_scores_of_classes_equal_those_of_records(spark):
    """Technical tokens of one record alone set no class apart and still count."""
    rows = [(1, "pump 11 20mm", "A1 5"), (2, "pump 12 20mm", "A2 5"), (3, "pump 13 x 4 30mm", "A3"), (4, "pump", ""), (5, "pump red 2 l", "A5 5 5"), (6, "pump 16 20mm", "A6 5")]
    own = enrich(spark.createDataFrame([(i, p, d) for i, d, p in rows], "rec_idx long, PART_NO string, DESCRIPTION string"))
    pairs = own.select(F.col("rec_idx").alias("idx_a")).crossJoin(own.select(F.col("rec_idx").alias("idx_b"))).where("idx_a < idx_b")
    shared = similarity.with_shared_technical(own)
    both = blocking.join_records(pairs, shared).select(similarity.technical_score().alias("x"), similarity.shared_technical_score().alias("y")).collect()
    assert len(both) == 15 and all(r.x == r.y for r in both) and len({r.x for r in both}) > 3
    alike = shared.where("rec_idx in (1, 2, 6)").select(F.to_json("shared_technical")).distinct()
    assert alike.count() == 1


@pytest.mark.parametrize("few", [False, True])
def test_only_records_counted_as_few_are_broadcast(spark, tmp_path, monkeypatch, few):
    """The files of records that repeat are small, so Spark by itself would broadcast them, however many there are."""
    monkeypatch.setattr(reuse, "BROADCAST_ROWS", 100 if few else 1)
    rows = [{"PART_NO": f"A{k}", "DESCRIPTION": "oil filter", "TYPE_CODE": "T"} for k in range(4)]
    enrich(ingest.with_index(ingest.from_records(spark, rows))).write.parquet(str(tmp_path / "records"))
    own = spark.read.parquet(str(tmp_path / "records"))
    pairs = own.agg(F.min("rec_idx").alias("idx_a"), F.max("rec_idx").alias("idx_b"))
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    joined = blocking.join_records(pairs, own)
    assert planned(joined) == (2 if few else 0) and joined.count() == 1
    if not few:
        monkeypatch.setattr(blocking, "BROADCAST_ROWS", 1)
        met = blocking.matches(*blocking.keyed(own, ["TYPE_CODE"], False))
        assert planned(met) == 0 and met.count() == 6
        scored = similarity.string_scores(pairs, own, {"text_description": ""}, parts=False)
        assert scored.count() == 1


def test_guards_are_scored_on_short_values(spark):
    """Status and score without texts equal those of the whole guard, in both modes; only short texts pass through the joins."""
    own = enrich(part_master(spark, "/root/testdata/sf0.001", MIXED)).where("rec_idx < 72").withColumn("PART_NO", F.concat(F.lit("p"), F.col("rec_idx").cast("string"))).cache()
    pairs = own.selectExpr("rec_idx as idx_a", "TYPE_CODE").join(own.selectExpr("rec_idx as idx_b", "TYPE_CODE"), "TYPE_CODE").where("idx_a < idx_b").drop("TYPE_CODE")
    values = own.select("rec_idx", *classic.guard_values(own))
    assert {kind for name, kind in values.dtypes if name != "rec_idx"} == {"string"}
    seen = set()
    for mode in vocab.SCAN_MODES:
        whole = blocking.join_records(pairs, own).withColumn("variant_mismatches", classic.variant_mismatches())
        want = {(r.idx_a, r.idx_b, r.status, r.score) for r in whole.select("idx_a", "idx_b", classic.hard_guard(whole, mode).alias("g")).select("idx_a", "idx_b", "g.status", "g.score").collect()}
        short = blocking.join_records(pairs, values)
        assert {(r.idx_a, r.idx_b, r.status, r.score) for r in short.select("idx_a", "idx_b", classic.guard_score(short, mode).alias("g")).select("idx_a", "idx_b", "g.status", "g.score").collect()} == want
        seen |= {s for *_, s, _ in want}
    assert {vocab.CONFLICT, vocab.RELATED, vocab.UNIQUE, vocab.CROSS_SITE, None} <= seen


def test_groups_of_classes_equal_those_of_pairs(spark):
    """Classes of many alike records, one record twice in two classes, a class paired with itself alone: no pair is opened."""
    texts = ["oil filter engine", "oil filter engine red", "copper cable", "steel pipe 10mm"]
    rows = [(k, f"P-{k}" if k != 41 else "P-40", texts[k // 20], "S1" if k % 2 else "S2") for k in range(78)]
    rows[41] = (41, "P-40", texts[2], "S2")
    own = enrich(spark.createDataFrame(rows, "rec_idx long, PART_NO string, DESCRIPTION string, CONTRACT string")).cache()
    found = blocking.alike(own, ["CONTRACT"], reads=["attrs"])
    df = found.valued(own, ["attrs"]).select("cls_a", "cls_b", "n_pairs", similarity.structured_score().alias("similarity_score")).where("similarity_score >= 40").cache()
    pairs = found.all_pairs(df.drop("n_pairs"))
    assert pairs.count() == df.agg(F.sum("n_pairs")).first()[0] > 10 * df.count()
    for s in "ab":
        pairs = pairs.join(own.select(F.col("rec_idx").alias(f"idx_{s}"), *[F.col(f).alias(f"{f.lower()}_{s}") for f in ("CONTRACT", "PART_NO", "DESCRIPTION")]), f"idx_{s}")
    none = F.array().cast("array<string>")
    shape = pairs.select("*", F.lit("HIGH").alias("confidence_level"), none.alias("matched_evidence"), none.alias("mismatched_fields"), F.array().cast("array<struct<type:string,feature:string>>").alias("differences"), F.lit("").alias("explanation")).cache()
    want = sorted(map(tuple, groups.duplicate_groups(shape, 40.0).collect()), key=repr)
    assert sorted(map(tuple, groups.class_groups(df, found, own).collect()), key=repr) == want and len(want) > 1
    members = groups.class_members(df, found, own)[0].select("node", "component").distinct()
    assert sorted(members.collect()) == sorted(groups.members(shape, 40.0).collect())


def test_statuses_of_classes_equal_those_of_pairs(spark):
    """Some pairs of classes are open until part numbers are scored; the others are counted, never opened."""
    texts = ["oil filter engine", "oil filter engine kit", "bolt", "paint red 20 l", "paint blue 20 l"]
    rows = [(k, f"AB{k}-{k % 3}-HOUSING" if k % 4 else f"Q{k}", texts[k // 6], "S1", "7" if k % 6 == 0 else "8" if k % 6 == 1 else None) for k in range(30)]
    own = enrich(spark.createDataFrame(rows, "rec_idx long, PART_NO string, DESCRIPTION string, CONTRACT string, HSN_SAC_CODE string"))
    own = similarity.with_shared_technical(own).cache()
    found = blocking.alike(own, ["CONTRACT"], reads=["CONTRACT", "HSN_SAC_CODE", "attrs", "is_generic", "shared_technical", *similarity.evidence_texts(own)])
    got = evidence.class_statuses(found, own).cache()
    want = evidence.statuses(found.all_pairs(found.pairs), own, ["CONTRACT"]).groupBy("business_status").count()
    assert sorted(map(tuple, got.groupBy("business_status").agg(F.sum("n_pairs")).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() < found.all_pairs(found.pairs).count() and want.count() > 3
