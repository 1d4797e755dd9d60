"""Names, queries and oracle SQL of the linkage engine over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, shown, vocab
from ..functions.attributes import enrich
from ..functions.text import domain_text, expand_apart, tokens
from ..operators import blocking, classic, evaluation, evidence, groups, results, similarity, validation
from ..operators.decisions import confidence_level
from ..operators.reuse import reused, scratch
from ..operators.similarity import spread
from ..sources import export, ingest, store
from . import oracle, scan
from .part_master import FIELDS, MIXED, MIXED_FIELDS, duckdb_view, part_master

WITH = f"with {oracle.RECORDS}"
PAIRS = f"{WITH}, {oracle.pair_tables(FIELDS)}"


def joined(x) -> Column:
    return F.array_join(x, "|")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(spread(part_master(spark, sf_dir), "rec_idx"))


def pairs(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return blocking.candidate_pairs(reused(records(spark, sf_dir), "records"), FIELDS, **options)


def class_pairs(spark: SparkSession, sf_dir: str, reads, *, ordered: bool = False, own: DataFrame | None = None, **options) -> tuple[DataFrame, blocking.Alike]:
    """Pairs of classes of records that are alike in the columns ``reads``, with both records of a pair that stands for them."""
    own = reused(records(spark, sf_dir), "records") if own is None else own
    found = blocking.alike(own, FIELDS, reads=reads, **options)
    return blocking.join_records(found.ordered() if ordered else found.pairs, found.records(own, reads)), found


def with_fields(df: DataFrame) -> DataFrame:
    matched, mismatched = blocking.field_matches(FIELDS)
    return df.withColumn("matched_fields", matched).withColumn("mismatched_fields", mismatched)


def normalize_records(spark, sf_dir):
    return records(spark, sf_dir).select("rec_idx", "normalized_part_no", "normalized_description", "normalized_text")


def normalize_documents(spark, sf_dir):
    text = read(spark, sf_dir, "documents").select("doc_id", domain_text("text").alias("t"))
    return text.select("doc_id", F.size(tokens("t")).cast("long").alias("n_tokens"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


def technical_tokens(spark, sf_dir):
    return records(spark, sf_dir).select("rec_idx", *[joined(f"technical.{n}").alias(n) for n in oracle.TECHNICAL])


def extract_attributes(spark, sf_dir):
    return records(spark, sf_dir).select("rec_idx", *[joined(f"attrs.{n}").alias(n) for n in oracle.ATTRIBUTES])


def variant_attributes(spark, sf_dir):
    return records(spark, sf_dir).select("rec_idx", *[joined(f"variants.{n}").alias(n.lower()) for n in oracle.VARIANTS])


def record_flags(spark, sf_dir):
    return records(spark, sf_dir).select("rec_idx", joined(F.array_sort("raw_context")).alias("raw_context"), "is_generic", "family")


def csv_canonical(spark, sf_dir):
    raw = read(spark, sf_dir, "supplier").selectExpr("s_name as ` part_no `", "case s_suppkey % 4 when 0 then 'NA' when 1 then 'null' else s_name end as Description", "cast(s_nationkey as string) as PART_TYPE", "'' as inventory_uom")
    return ingest.missing_as_null(ingest.canonical_columns(raw))


def profile_validate(spark, sf_dir):
    df = part_master(spark, sf_dir)
    return validation.profile(df, ["HSN_SAC_CODE", "PRODUCT_CATEGORY_ID", "MASTER_PART_DESCRIPTION"]).toDF("record_count", "empty_descriptions", "blank_hsn", "blank_category", "blank_master")


def high_null_fields(spark, sf_dir):
    return validation.sparse_fields(part_master(spark, sf_dir), ["HSN_SAC_CODE", "HAZARD_CODE", "MASTER_PART_DESCRIPTION"])


def repeated_part_rows(spark, sf_dir):
    return validation.repeated_part_rows(read(spark, sf_dir, "part").selectExpr("case when p_partkey % 9 = 0 then null else p_name end as PART_NO"))


def sensitive_patterns(spark, sf_dir):
    return validation.sensitive_patterns(read(spark, sf_dir, "documents"))


def block_index(spark, sf_dir):
    return blocking.blocks(records(spark, sf_dir), FIELDS).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_records"), F.min("rec_idx").alias("first_record"))


def shown_pairs(df):
    return df.select("idx_a", "idx_b", joined("candidate_reasons").alias("candidate_reasons"), joined("matched_blocks").alias("matched_blocks"))


def candidate_pairs(spark, sf_dir):
    return shown_pairs(pairs(spark, sf_dir))


def candidate_pairs_cross_site(spark, sf_dir):
    return shown_pairs(pairs(spark, sf_dir, cross_site=True))


def candidate_pairs_capped(spark, sf_dir):
    return shown_pairs(pairs(spark, sf_dir, cross_site=True, most=vocab.PAIR_LIMIT))


def records_without_candidates(spark, sf_dir):
    found = blocking.alike(reused(records(spark, sf_dir), "records"), FIELDS)
    paired = found.pairs.select(F.col("cls_a").alias("cls")).union(found.pairs.select("cls_b")).distinct()
    met = found.members.join(paired, "cls").select(F.explode("ids").alias("rec_idx"))
    return part_master(spark, sf_dir).select("rec_idx", "PART_NO").join(met, "rec_idx", "left_anti")


def matched_fields(spark, sf_dir):
    df, found = class_pairs(spark, sf_dir, FIELDS, cross_site=True)
    return found.all_pairs(with_fields(df).select("cls_a", "cls_b", joined("matched_fields").alias("matched_fields"), joined("mismatched_fields").alias("mismatched_fields")))


def set_scores(spark, sf_dir):
    own = reused(similarity.with_shared_technical(reused(records(spark, sf_dir), "records")), "records")
    df, found = class_pairs(spark, sf_dir, [*FIELDS, "attrs", "shared_technical"], own=own)
    df = with_fields(df).select("cls_a", "cls_b", similarity.shared_technical_score().alias("technical_score"), similarity.structured_score().alias("structured_score"), similarity.business_score(F.col("matched_fields"), F.col("mismatched_fields")).alias("business_score"))
    return found.all_pairs(df)


def text_pairs(spark, sf_dir):
    df = class_pairs(spark, sf_dir, ["text_description"], ordered=True)[0]
    return df.select(F.col("a.text_description").alias("ta"), F.col("b.text_description").alias("tb")).distinct()


def tfidf_pairs(spark, sf_dir):
    found = reused(text_pairs(spark, sf_dir), "text-pairs")
    return similarity.with_text_scores(found, "ta", "tb").select("ta", "tb", "tfidf_score")


def fuzzy_pairs(spark, sf_dir):
    found = reused(text_pairs(spark, sf_dir), "text-pairs")
    return similarity.with_text_scores(found, "ta", "tb").select("ta", "tb", "fuzzy_score")


#: Suppliers of a nation whose names lie in one row, about.
NAMES = 40


def part_no_similarity(spark, sf_dir):
    own = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.replace(domain_text("s_name"), F.lit(" "), F.lit("")).alias("t"))
    counts = own.groupBy("s_nationkey").agg((F.floor(F.count(F.lit(1)) / NAMES) + 1).alias("parts"))
    placed = own.join(counts, "s_nationkey").groupBy(F.col("s_nationkey").alias("n"), F.pmod(F.xxhash64("s_suppkey"), "parts").alias("part"))
    parts = reused(placed.agg(F.collect_list(F.struct("s_suppkey", "t")).alias("m")).select("n", "part", F.col("m.s_suppkey").alias("ids"), F.col("m.t").alias("ts")), "names")
    side = lambda s: parts.toDF("n", f"part_{s}", f"ids_{s}", f"ts_{s}")
    met = blocking.dealt(side("a").join(side("b"), "n").where("part_a <= part_b").drop("n"))
    scored = fuzzy.cross_part_scores(met, "ts_a", "ts_b", "scores")
    opened = blocking.crossed(scored).where("x <> y and (part_a < part_b or x < y)")
    return opened.select(F.least("x", "y").alias("idx_a"), F.greatest("x", "y").alias("idx_b"), F.col("score").alias("part_no_similarity"))


#: What the hard guards of the classic engine and the findings of the evidence engine look at, of the given records.
GUARDED = ["CONTRACT", *dict.fromkeys(f for f, *_ in vocab.HARD_FIELDS), "variants", "family"]
FOUND = [*FIELDS, "CONTRACT", "HSN_SAC_CODE", "HAZARD_CODE", "attrs", "is_generic"]


def scored_guards(spark, sf_dir):
    """cls_a, cls_b, n_pairs, score and status of the pairs of classes that a hard guard stops; no texts are made."""
    own = reused(records(spark, sf_dir), "records")
    found = blocking.alike(own, FIELDS, reads=GUARDED)
    df = found.valued(own, classic.guard_values(own))
    df = df.select("cls_a", "cls_b", "n_pairs", classic.guard_score(df, vocab.SCAN_MODES[0]).alias("g")).where("g is not null")
    return df.select("cls_a", "cls_b", "n_pairs", F.col("g.score").alias("similarity_score"), F.col("g.status").alias("business_status")), found


def guarded_classes(spark, sf_dir, ordered=False):
    """Hard guards of pairs of classes, with their texts."""
    df, found = class_pairs(spark, sf_dir, GUARDED, ordered=ordered)
    df = df.withColumn("variant_mismatches", classic.variant_mismatches())
    guard = df.select("cls_a", "cls_b", classic.hard_guard(df, vocab.SCAN_MODES[0]).alias("g"))
    return guard.select("cls_a", "cls_b", "g.status", "g.rule_decision", "g.rejection_reason", "g.score", "g.explanation"), found


def classic_guards(spark, sf_dir):
    guard, found = guarded_classes(spark, sf_dir, ordered=True)
    return found.all_pairs(guard, ordered=True)


def evidence_guards(spark, sf_dir):
    df, found = class_pairs(spark, sf_dir, FOUND)
    df = evidence.findings(with_fields(df), cross_site=False)
    data = F.exists("rule_evidence", lambda d: d["severity"] == "data_conflict")
    return found.all_pairs(df.select("cls_a", "cls_b", joined("conflict_types").alias("conflict_types"), joined("warning_types").alias("warning_types"), data.alias("data_conflict")))


SHOWN = ("idx_a", "idx_b", "similarity_score", "confidence_level", "description_similarity", "tfidf_score", "fuzzy_score", "part_no_similarity", "technical_token_score", "business_status", "rule_decision", "rejection_reason", "recommended_action", "explanation")


LISTS = ("matched_fields", "mismatched_fields", "matched_evidence", "difference_kinds", "warnings")


def shown_lists() -> list:
    """The lists of a candidate as texts."""
    kinds = F.transform("differences", lambda d: F.coalesce(d["type"], d["feature"]))
    return [joined(kinds if n == "difference_kinds" else n).alias(n) for n in LISTS]


def shown_results(found, keys=()):
    """Candidates with their lists as texts."""
    return found.select(*keys, *SHOWN, *shown_lists(), F.col("generic_description_warning").alias("generic_warning"), F.col("application_context_warning").alias("context_warning"))


def described(spark, sf_dir):
    """Records as a scan takes them, with the technical tokens that they share."""
    return reused(similarity.with_shared_technical(reused(enrich(spread(ingest.with_description(part_master(spark, sf_dir)), "rec_idx")), "records")), "records")


def classic_results(spark, sf_dir):
    own = described(spark, sf_dir)
    df, found = class_pairs(spark, sf_dir, list(dict.fromkeys([*FIELDS, *classic.READS])), ordered=True, own=own)

    def shown(decided):
        keys = [c for c in ("cls_a", "cls_b") if c in decided.columns]
        indexes = [c for c in ("idx_a", "idx_b") if c not in decided.columns]
        return shown_results(results.decisions(decided.withColumns(dict.fromkeys(indexes, F.lit(None))), ("idx_a", "idx_b", *keys)), keys)

    return classic.decide_classes(df, found, own, FIELDS, shown)


def evidence_results(spark, sf_dir):
    own = described(spark, sf_dir)
    found = blocking.alike(evidence.class_records(own), FIELDS, reads=list(dict.fromkeys([*FIELDS, *evidence.READS])))
    texts = similarity.string_scores(found.ordered(), own, similarity.evidence_texts(own), parts=False)
    df = blocking.join_records(reused(texts, "text-scores"), found.records(evidence.class_records(own), [*FIELDS, *evidence.READS]))
    flags = {"generic_warning": "generic_description_warning", "context_warning": "application_context_warning"}
    lists = [c.alias(f"{n}__") for n, c in zip(LISTS, shown_lists(), strict=True)]
    decided = evidence.decide_classes(df, found, own, FIELDS, [*lists, *[results.warned()[c].alias(n) for n, c in flags.items()]])
    renamed = decided.withColumnsRenamed({"final_score": "similarity_score", "status": "business_status"})
    return renamed.select(*SHOWN, *[F.col(f"{n}__").alias(n) for n in LISTS], *flags)


def lot_pairs(spark, sf_dir):
    """Enriched records of the mixed assortments, and all pairs inside a lot of twelve, whatever blocking would say."""
    own = reused(enrich(part_master(spark, sf_dir, MIXED)), "records")
    side = lambda x: own.select("TYPE_CODE", F.col("rec_idx").alias(f"idx_{x}"))
    return own, side("a").join(side("b"), "TYPE_CODE").where("idx_a < idx_b").select("idx_a", "idx_b")


def classic_decisions(spark, sf_dir, mode=vocab.SCAN_MODES[0]):
    own, met = lot_pairs(spark, sf_dir)
    return shown_results(results.candidates(classic.decide(met, own, MIXED_FIELDS, mode)))


def classic_decisions_cross_site(spark, sf_dir):
    return classic_decisions(spark, sf_dir, vocab.SCAN_MODES[1])


def evidence_decisions(spark, sf_dir, fields=MIXED_FIELDS, cross_site=False):
    own, met = lot_pairs(spark, sf_dir)
    return shown_results(results.candidates(evidence.decide(met, own, fields, cross_site)))


def evidence_decisions_cross_site(spark, sf_dir):
    """With one selected field, so that pairs without any matching evidence occur."""
    return evidence_decisions(spark, sf_dir, MIXED_FIELDS[1:], cross_site=True)


def evidence_status_summary(spark, sf_dir):
    own = reused(similarity.with_shared_technical(reused(records(spark, sf_dir), "records")), "records")
    found = blocking.alike(own, FIELDS, reads=[*FOUND, "shared_technical", *similarity.evidence_texts(own)])
    return results.status_counts(evidence.class_statuses(found, own), weight="n_pairs")


def guard_status_summary(spark, sf_dir):
    return results.status_counts(scored_guards(spark, sf_dir)[0], weight="n_pairs")


def review_filter(spark, sf_dir):
    rows, found = scored_guards(spark, sf_dir)
    kept = results.kept(rows.drop("n_pairs"), 46.0, results.allowed_statuses("review"))
    return found.all_pairs(blocking.dealt(reused(kept, "kept-classes")))


def classes_scored_by_structure(spark, sf_dir):
    """Pairs of classes scored by structure alone that reach the least score of a group, their classes and the records."""
    own = reused(records(spark, sf_dir), "records")
    found = blocking.alike(own, FIELDS, reads=["attrs"])
    df = found.valued(own, [F.struct(*[F.col(f"attrs.{n}").alias(n) for n in vocab.FEATURES]).alias("attrs")])
    scored = df.select("cls_a", "cls_b", "n_pairs", similarity.structured_score().alias("similarity_score")).where(F.col("similarity_score") >= GROUP_MINIMUM)
    return reused(scored, "scored-classes"), found, own


def produced_and_kept(spark, sf_dir):
    return results.produced_and_kept(scored_guards(spark, sf_dir)[0], 50.0, vocab.REVIEW_STATUSES, weight="n_pairs")


GROUP_MINIMUM = 90.0


def duplicate_groups(spark, sf_dir):
    found = groups.class_groups(*classes_scored_by_structure(spark, sf_dir))
    return found.select("group_id", "group_name", "part_count", "pair_count", "average_score", "top_score", "confidence_level", "summary")


def group_members(spark, sf_dir):
    return groups.class_members(*classes_scored_by_structure(spark, sf_dir))[0].select("node", "component").distinct()


def export_rows(spark, sf_dir):
    own = reused(records(spark, sf_dir), "records")
    df, found = class_pairs(spark, sf_dir, list(dict.fromkeys([*FIELDS, *GUARDED, "attrs", "DESCRIPTION"])), ordered=True, own=own)
    df = with_fields(df.withColumn("variant_mismatches", classic.variant_mismatches()))
    told = ("cls_a", "cls_b", "matched_fields", F.col("b.DESCRIPTION").alias("d"), F.col("a.attrs.color").alias("application_context_a"), F.col("a.variants").alias("variant_attributes_a"))
    # written once, so that the guards are not evaluated for each cell
    df = reused(df.select(*told, classic.hard_guard(df, vocab.SCAN_MODES[0]).alias("g")), "guarded-classes").where("g is not null")
    rows = df.select(
        "cls_a",
        "cls_b",
        F.concat(F.lit("="), F.col("d")).alias("description_b"),
        F.col("g.score").alias("similarity_score"),
        F.col("g.explanation").alias("explanation"),
        "matched_fields",
        F.col("matched_fields").alias("matched_evidence"),
        "application_context_a",
        "variant_attributes_a",
    )
    kept = ("description_a", "description_b", "similarity_score", "score", "reason", "matched_fields", "matched_evidence", "application_context_a", "variant_attributes_a", "review_status")
    texts = blocking.dealt(reused(export.export_rows(rows, ("cls_a", "cls_b")).select("cls_a", "cls_b", *kept), "export-classes"))
    # part numbers alone set the pairs of two classes apart
    return found.valued_pairs(texts, own.select("rec_idx", export.guarded(F.col("PART_NO")))).select(F.col("value_a").alias("part_no_a"), *kept)


def feedback_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderstatus").alias("decision"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("feedback_id"))
    return store.latest_feedback(rows, ["candidate_id"]).select("candidate_id", "decision", "feedback_id")


def evaluation_metrics(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return evaluation.metrics(labels.select(F.col("toxic").alias("expected_label"), (F.col("quality") == 0).cast("int").alias("guess")))


SYNTHETIC_FIELDS = ["CONTRACT", "UNIT_MEAS", "PRIME_COMMODITY"]


def made_up(spark, sf_dir):
    """Five made-up records for each supplier."""
    return ingest.synthetic(spark, read(spark, sf_dir, "supplier").count() * 5)


def synthetic_records(spark, sf_dir):
    return made_up(spark, sf_dir)


def synthetic_scan(spark, sf_dir):
    """A scan of made-up records, up to the pair limit of an interactive scan."""
    found = scan.run_scan(made_up(spark, sf_dir), SYNTHETIC_FIELDS, threshold=70.0, most=vocab.PAIR_LIMIT).candidates
    return shown_results(found)


def csv_scan(spark, sf_dir):
    """A CSV file with aliases, missing texts, quotes and commas, as a scan reads it."""
    path = scratch(spark, "suppliers")
    raw = read(spark, sf_dir, "supplier").selectExpr(
        "s_name as ` part_no `", "case s_suppkey % 4 when 0 then 'NA' when 1 then 'null' else concat(s_name, ', \"of\" ', cast(s_nationkey as string)) end as Description", "cast(s_nationkey as string) as PART_TYPE", "'' as inventory_uom"
    )
    raw.write.option("header", True).option("escape", '"').csv(path)
    return ingest.read_csv(spark, path, max_rows=None, max_bytes=None)


def file_fingerprint(spark, sf_dir):
    path = scratch(spark, "regions")
    read(spark, sf_dir, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path)
    return ingest.fingerprint(spark, path).select("file_sha256")


def input_guards(spark, sf_dir):
    """What reading says of an empty file, a file beyond the limits, one without rows, and a good one."""
    suppliers = read(spark, sf_dir, "supplier").selectExpr("s_name as PART_NO", "s_name as DESCRIPTION").coalesce(1)
    full, bare, empty = (scratch(spark, n) for n in ("full", "bare", "empty"))
    suppliers.write.option("header", True).csv(full)
    suppliers.limit(0).write.option("header", True).csv(bare)
    suppliers.limit(0).select("PART_NO").coalesce(1).write.text(empty)
    rows = []
    for case, path, limits in (("empty", empty, {}), ("no rows", bare, {}), ("bytes", full, {"max_bytes": 10}), ("rows", full, {"max_rows": 1}), ("good", full, {})):
        try:
            rows.append((case, "read" if ingest.read_csv(spark, path, **limits).columns else ""))
        except ingest.RecordError as error:
            rows.append((case, type(error).__name__))
    return spark.createDataFrame(rows, "case string, outcome string")


def in_memory_records(spark, sf_dir):
    return ingest.with_description(ingest.from_records(spark, read(spark, sf_dir, "nation").selectExpr("n_name as ` description`", "case when n_nationkey % 3 = 0 then null else n_name end as part_no", "cast(n_regionkey as string) as safety_code"))).select("PART_NO", "DESCRIPTION", "HAZARD_CODE")


def described_records(spark, sf_dir):
    return ingest.with_description(part_master(spark, sf_dir).selectExpr("rec_idx", "case when rec_idx % 7 = 0 then null when rec_idx % 7 = 1 then '  ' else DESCRIPTION end as DESCRIPTION"))


FIELD_TEXTS = ("", '["a", " b "]', "type_code, unit_meas,", "  contract ", "[1, 2]")


def field_parser(spark, sf_dir):
    return spark.createDataFrame([(text, "|".join(validation.parse_fields(text))) for text in FIELD_TEXTS], "given string, fields string")


def spoiled(spark, sf_dir):
    """Part records with blank descriptions, repeated part numbers and sensitive notes."""
    return part_master(spark, sf_dir).selectExpr(
        "case when rec_idx % 9 = 0 then 'P-0' else PART_NO end as PART_NO",
        "case when rec_idx % 10 = 0 then ' ' else DESCRIPTION end as DESCRIPTION",
        "MASTER_PART_DESCRIPTION", "HAZARD_CODE",
        "case rec_idx % 50 when 3 then 'ask a.b@c.org' when 4 then 'job-1234' when 5 then 'vendor: Acme 12' end as NOTE",
    )


WARNED_FIELDS = ("HAZARD_CODE", "MASTER_PART_DESCRIPTION", "GONE")


def validation_warnings(spark, sf_dir):
    return validation.warnings(spoiled(spark, sf_dir), WARNED_FIELDS)


STOPPED_AT = 500


def scan_warnings(spark, sf_dir):
    """What a scan with an absent and a sparse field says that its limit of pairs stops."""
    said = scan.run_scan(part_master(spark, sf_dir), ["TYPE_CODE", "GONE", "MASTER_PART_DESCRIPTION"], most=STOPPED_AT).warnings
    return spark.createDataFrame([(w["warning_type"], w["message"]) for w in said], "warning_type string, message string")


STORED_THRESHOLD = 60.0


def store_lots(spark, sf_dir):
    """A store with one scan of the mixed lots, and two reviews of its best candidate."""
    kept = store.Store(spark, scratch(spark, "store"))
    scan_id = scan.run_stored_scan(kept, part_master(spark, sf_dir, MIXED), [*MIXED_FIELDS, "GONE"], name=" lots ", threshold=STORED_THRESHOLD)
    best = kept.ranked_candidates(scan_id).select("idx_a", "idx_b").first()
    for decision in ("UNSURE", "DUPLICATE"):
        kept.add_feedback(scan_id, best["idx_a"], best["idx_b"], decision, "first")
    return kept, scan_id


def stored_scan(spark, sf_dir):
    kept, scan_id = store_lots(spark, sf_dir)
    summary = kept.summary()
    counts = [F.lit(summary[n]).cast("long").alias(f"n_{n}") for n in ("scans", "candidates", "feedback")]
    return kept.scans().select("name", "status", "record_count", "total_candidates", "warnings_count", "threshold", "scan_mode", *counts, F.lit(summary["latest_scan"]["name"]).alias("latest"), F.lit(kept.warnings(scan_id).first()["message"]).alias("warning"))


def stored_candidates(spark, sf_dir):
    """The candidates of a stored scan, the most similar first, with their reviews."""
    kept, scan_id = store_lots(spark, sf_dir)
    ranked = groups.numbered(kept.candidates(scan_id).withColumn("o", F.struct((-F.col("similarity_score")).alias("s"), "idx_a", "idx_b")), "o", "place")
    return ranked.select("place", "idx_a", "idx_b", "similarity_score", "business_status", "review_status", "reviewed_by")


def candidate_rows(spark, sf_dir):
    """Candidates in the shape that is stored, without scores."""
    own, met = lot_pairs(spark, sf_dir)
    found = results.candidates(classic.decide(met, own, MIXED_FIELDS))
    record = [f"{c}_{s}" for s in "ab" for c in ("contract", "part_no", "description", "normalized_part_no", "normalized_description")]
    attributes = [joined(f"extracted_attributes_{s}.{n}").alias(f"{n}_{s}") for s in "ab" for n in ("product_class", "rating", "color", "generic_terms")]
    return found.select("idx_a", "idx_b", *record, *attributes, joined("application_context_a").alias("context_a"), joined("variant_attributes_b.SIZE").alias("size_b"), joined(F.transform("critical_mismatches", lambda d: d["type"])).alias("critical"), "scan_mode", "review_status")


def parted_texts(spark, sf_dir):
    """Another normal form of descriptions and part numbers, which parts letters from digits."""
    return part_master(spark, sf_dir, MIXED).select("rec_idx", expand_apart("DESCRIPTION").alias("description"), expand_apart("PART_NO").alias("part_no"))


def safe_filenames(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", export.safe_filename(F.when(F.col("page_id") % 10 == 0, F.lit("/?")).otherwise(F.col("url"))).alias("filename"))


def candidate_view(spark, sf_dir):
    """What a result list shows of exported candidates."""
    own, met = lot_pairs(spark, sf_dir)
    found = results.candidates(classic.decide(met, own, MIXED_FIELDS))
    rows = export.export_rows(found).withColumnsRenamed({"score": "exported_score"})
    text = lambda c: F.col(c)
    return rows.select(
        "part_no_a", "part_no_b", "description_a", "description_b", shown.score(F.lit(None), text("exported_score"), text("similarity_score")).alias("score"), shown.number(text("explanation")).alias("no_number"),
        shown.status(text("business_status"), text("review_status")).alias("status"), shown.display(text("matched_fields")).alias("matched"), F.size(shown.listed(text("matched_evidence"))).alias("n_evidence"), shown.display(text("rejection_reason")).alias("reason"),
    )


def field_picker(spark, sf_dir):
    """Fields that a user may select."""
    return field_catalogue(spark, sf_dir).where("not required").select("field", "display")


def scan_groups(spark, sf_dir):
    """Duplicate groups of decided candidates, with the fields that their pairs share and differ in."""
    own, met = lot_pairs(spark, sf_dir)
    found = groups.duplicate_groups(results.candidates(classic.decide(met, own, MIXED_FIELDS)))
    return found.select("group_id", "group_name", "part_count", "pair_count", "average_score", "top_score", "confidence_level", joined("matched_fields").alias("matched_fields"), joined("mismatched_fields").alias("mismatched_fields"), "summary")


def scored_labels(spark, sf_dir):
    """Labelled pairs of neighbouring lot records, written and read as CSV and scored by the classic engine."""
    path = scratch(spark, "labelled-pairs")
    rows = part_master(spark, sf_dir, MIXED).selectExpr("rec_idx", "DESCRIPTION")
    both = rows.toDF("pair_id", "description_a").where("pair_id % 2 = 1").join(rows.selectExpr("rec_idx - 1 as pair_id", "DESCRIPTION as description_b"), "pair_id")
    both.selectExpr("pair_id", "description_a", "description_b", "cast(pair_id % 3 = 0 as int) as expected_label").write.option("header", True).option("escape", '"').csv(path)
    return evaluation.score_pairs(evaluation.read_pairs(spark, path))


def labelled_scores(spark, sf_dir):
    return scored_labels(spark, sf_dir)


def labelled_metrics(spark, sf_dir):
    return evaluation.metrics(scored_labels(spark, sf_dir))


def field_catalogue(spark, sf_dir):
    rows = [(*f, vocab.FIELD_ROLES.get(f[0])) for f in vocab.FIELDS]
    return spark.createDataFrame(rows, "field string, display string, required boolean, role string")


QUERIES = (
    normalize_records, normalize_documents, technical_tokens, extract_attributes, variant_attributes, record_flags, csv_canonical, profile_validate, high_null_fields, repeated_part_rows,
    sensitive_patterns, block_index, candidate_pairs, candidate_pairs_cross_site, candidate_pairs_capped, records_without_candidates, matched_fields, set_scores, tfidf_pairs, fuzzy_pairs,
    part_no_similarity, classic_guards, evidence_guards, classic_results, evidence_results, evidence_status_summary, classic_decisions, classic_decisions_cross_site, evidence_decisions, evidence_decisions_cross_site, guard_status_summary, review_filter, produced_and_kept, duplicate_groups, group_members,
    export_rows, feedback_latest, evaluation_metrics, synthetic_records, synthetic_scan, field_catalogue, csv_scan, file_fingerprint, input_guards, in_memory_records, described_records, field_parser,
    validation_warnings, scan_warnings, stored_scan, stored_candidates, candidate_rows, candidate_view, field_picker, parted_texts, safe_filenames, scan_groups, labelled_scores, labelled_metrics,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the decided candidate pairs of the part master by status."""
    return evidence_status_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    o = oracle
    show = lambda names, prefix="": ", ".join(f"{o.joined(prefix + n)} as {n}" for n in names)
    matched, mismatched = o.field_lists(FIELDS)
    blank = lambda f: f"count(*) filter (where {o.strip(f)} = '')"
    cells = []
    for kind, pattern, _ in vocab.SENSITIVE:
        for column in ("text", "lang", "source"):
            cells.append(f"select '{kind}' as warning_type, '{column}' as c, count(*) filter (where regexp_matches(coalesce({column}, ''), '{pattern}')) as n from documents")
    guard_rows = f"{PAIRS}, gd as ({o.classic_guards()})"
    node = lambda s: f"concat_ws('|', coalesce({s}.CONTRACT, ''), coalesce({s}.PART_NO, ''), coalesce({s}.DESCRIPTION, ''))"
    scored = f"sc as (select idx_a, idx_b, {node('a')} as node_a, {node('b')} as node_b, {o.structured_score()} as similarity_score from {o.both()}), sl as (select *, case when similarity_score >= 90 then 'HIGH' when similarity_score >= 75 then 'MEDIUM' when similarity_score >= 60 then 'LOW' else 'IGNORE' end as level from sc)"
    grouped = f"{PAIRS.replace('with ', 'with recursive ', 1)}, {scored}, {o.groups('sl', GROUP_MINIMUM)}"
    lots = f"with {o.records(duckdb_view(MIXED))}, prs as (select a.rec_idx as idx_a, b.rec_idx as idx_b from pm a join pm b on a.TYPE_CODE = b.TYPE_CODE and a.rec_idx < b.rec_idx)"
    texts = "st as (select rec_idx, {} as t from rec), sp as (select distinct a.t as ta, b.t as tb from prs join st a on a.rec_idx = idx_a join st b on b.rec_idx = idx_b)".format(o.similarity_words("ndesc0"))
    variants = "{" + ", ".join(f"'{n}': a.v_{n}" for n in o.VARIANTS) + "}"
    texts_of = vocab.WARNING_TEXTS
    spoiled_rows = f"""with pm as (select case when rec_idx % 9 = 0 then 'P-0' else PART_NO end as PART_NO, case when rec_idx % 10 = 0 then ' ' else DESCRIPTION end as DESCRIPTION, MASTER_PART_DESCRIPTION, HAZARD_CODE,
 case rec_idx % 50 when 3 then 'ask a.b@c.org' when 4 then 'job-1234' when 5 then 'vendor: Acme 12' end as NOTE from ({duckdb_view()}))"""
    fill = lambda kind, **values: "'" + texts_of[kind].replace("'", "''").format(**{k: f"' || {v} || '" for k, v in values.items()}) + "'"
    share = lambda f: f"floor({blank(f)} / count(*) * 1000 + 0.5) / 10"
    columns = ("PART_NO", "DESCRIPTION", "MASTER_PART_DESCRIPTION", "HAZARD_CODE", "NOTE")
    sensitive_cells = " union all ".join(f"select '{kind}' as k, '{what}' as what, '{c}' as c, count(*) filter (where regexp_matches(coalesce({c}, ''), '{pattern}')) as n from pm" for kind, pattern, what in vocab.SENSITIVE for c in columns)
    made = o.synthetic("select count(*) * 5 from supplier")
    made_records = f"select *, cast(null as varchar) as MASTER_PART_DESCRIPTION from ({made})"
    stored = f"with {o.records(duckdb_view(MIXED))}, {o.pair_tables(MIXED_FIELDS)}, {o.classic_decisions(MIXED_FIELDS)}, st_kept as (select * from decided where similarity_score >= {STORED_THRESHOLD})"
    sides = ("a", "b")
    record = ", ".join(f"{o.strip(f'{s}.{f}')} as {f.lower()}_{s}" for s in sides for f in ("CONTRACT", "PART_NO", "DESCRIPTION")) + ", " + ", ".join(f"{s}.npart as normalized_part_no_{s}, {s}.ndesc as normalized_description_{s}" for s in sides)
    record += ", " + ", ".join(f"{o.joined(f'{s}.at_{n}')} as {n}_{s}" for s in sides for n in ("product_class", "rating", "color", "generic_terms"))
    lot_groups = f"{lots.replace('with ', 'with recursive ', 1)}, {o.classic_decisions(MIXED_FIELDS)}, sl as (select d.*, confidence_level as level, {node('a')} as node_a, {node('b')} as node_b from decided d join rec a on a.rec_idx = idx_a join rec b on b.rec_idx = idx_b), {o.groups('sl', groups.MINIMUM)}"
    parted = lambda x: f"list_filter(string_split({x}, '|'), lambda v: v <> '')"
    labelled = o.labelled_pairs(duckdb_view(MIXED))
    return {
        "synthetic_records": f"with pm as ({made}) select * from pm",
        "synthetic_scan": f"with {o.records(made_records)}, {o.pair_tables(SYNTHETIC_FIELDS, cap=vocab.PAIR_LIMIT)}, {o.classic_decisions(SYNTHETIC_FIELDS)} select * from decided where similarity_score >= 70",
        "csv_scan": """select s_name as PART_NO, case when s_suppkey % 4 in (0, 1) then null else s_name || ', "of" ' || s_nationkey end as DESCRIPTION, cast(s_nationkey as varchar) as TYPE_CODE, cast(null as varchar) as UNIT_MEAS from supplier""",
        "file_fingerprint": "select sha256(string_agg(r_name || chr(10), '' order by r_name)) as file_sha256 from region",
        "input_guards": "select * from (values ('empty', 'RecordError'), ('no rows', 'RecordError'), ('bytes', 'TooLarge'), ('rows', 'TooLarge'), ('good', 'read')) v(\"case\", outcome)",
        "in_memory_records": "select case when n_nationkey % 3 = 0 then '' else n_name end as PART_NO, n_name as DESCRIPTION, cast(n_regionkey as varchar) as HAZARD_CODE from nation",
        "described_records": f"select rec_idx, DESCRIPTION from ({duckdb_view()}) where rec_idx % 7 not in (0, 1)",
        "field_parser": "select * from (values ('', ''), ('[\"a\", \" b \"]', 'A|B'), ('type_code, unit_meas,', 'TYPE_CODE|UNIT_MEAS'), ('  contract ', 'CONTRACT'), ('[1, 2]', '1|2')) v(given, fields)",
        "validation_warnings": f"""{spoiled_rows}, cells as ({sensitive_cells}), n as (select {blank('DESCRIPTION')} as e from pm),
 r as (select coalesce(sum(c), 0)::bigint as c from (select count(*) as c from pm group by coalesce(PART_NO, '')) where c > 1),
 sp as ({' union all '.join(f"select '{f}' as f, {share(f)} as p, {blank(f)} / count(*) as s from pm" for f in WARNED_FIELDS[:2])})
 select 'EMPTY_DESCRIPTION' as warning_type, cast(null as varchar) as subject, {fill('EMPTY_DESCRIPTION', n='e')} as message from n where e > 0
 union all select 'DUPLICATE_PART_NO', null, {fill('DUPLICATE_PART_NO', n='c')} from r where c > 0
 union all select 'MISSING_SELECTED_FIELD', 'GONE', {fill('MISSING_SELECTED_FIELD', field="'GONE'")}
 union all select 'HIGH_NULL_FIELD', f, {fill('HIGH_NULL_FIELD', field='f', percent='p')} from sp where s >= 0.5
 union all select k, cols, {fill('SENSITIVE', n='n', what='what', columns='cols')} from (select k, what, cast(sum(n) as bigint) as n, string_agg(c, ', ' order by c) as cols from cells where n > 0 group by 1, 2)""",
        "scan_warnings": f"""{WITH}, {o.pair_tables(['TYPE_CODE'])}, sp as (select {share('MASTER_PART_DESCRIPTION')} as p from pm)
 select 'MISSING_SELECTED_FIELD' as warning_type, {fill('IGNORED_FIELD', field="'GONE'")} as message
 union all select 'HIGH_NULL_FIELD', {fill('HIGH_NULL_FIELD', field="'MASTER_PART_DESCRIPTION'", percent='p')} from sp
 union all select 'PAIR_LIMIT_REACHED', {fill('PAIR_LIMIT_REACHED', most=f"'{STOPPED_AT}'")} where (select count(*) from prs) >= {STOPPED_AT}""",
        "stored_scan": f"""{stored} select 'lots' as name, 'COMPLETED' as status, (select count(*) from part) as record_count, count(*) as total_candidates, 1::bigint as warnings_count, {STORED_THRESHOLD}::double as threshold, '{vocab.SCAN_MODES[0]}' as scan_mode,
 1::bigint as n_scans, count(*) as n_candidates, 2::bigint as n_feedback, 'lots' as latest, {fill('IGNORED_FIELD', field="'GONE'")} as warning from st_kept""",
        "stored_candidates": f"""{stored}, rk as (select row_number() over (order by similarity_score desc, idx_a, idx_b) as place, * from st_kept)
 select place, idx_a, idx_b, similarity_score, business_status, case when place = 1 then 'DUPLICATE' else 'UNREVIEWED' end as review_status, case when place = 1 then 'first' end as reviewed_by from rk""",
        "candidate_rows": f"""{lots}, {o.classic_decisions(MIXED_FIELDS)} select idx_a, idx_b, {record}, {o.joined('a.at_application_context')} as context_a, {o.joined('b.v_SIZE')} as size_b, difference_kinds as critical,
 '{vocab.SCAN_MODES[0]}' as scan_mode, 'UNREVIEWED' as review_status from {o.both('decided')}""",
        "parted_texts": f"with pm as ({duckdb_view(MIXED)}) select rec_idx, {o.expand_apart('DESCRIPTION')} as description, {o.expand_apart('PART_NO')} as part_no from pm",
        "safe_filenames": r"select page_id, coalesce(nullif(regexp_replace(case when page_id % 10 = 0 then '/?' else url end, '[^\p{L}\p{N}\-_.]', '', 'g'), ''), 'export.csv') as filename from pages",
        "candidate_view": f"""{lots}, {o.classic_decisions(MIXED_FIELDS)} select {', '.join(f"{o.strip(f'{s}.{f}')} as {f.lower()}_{s}" for f in ('PART_NO', 'DESCRIPTION') for s in sides)}, floor(similarity_score * 10 + 0.5) / 10 as score, 0.0::double as no_number,
 case business_status {' '.join(f"when '{k}' then '{v}'" for k, v in vocab.STATUS_NAMES.items())} end as status, case when matched_fields = '' then '-' else replace(matched_fields, '|', '; ') end as matched,
 case when matched_evidence = '' then 0 else 1 end as n_evidence, case when rejection_reason = '' then '-' else rejection_reason end as reason from {o.both('decided')}""",
        "field_picker": "select * from (values " + ", ".join(f"({o.quoted(f)}, {o.quoted(d)})" for f, d, r in vocab.FIELDS if not r) + ") v(field, display)",
        "scan_groups": f"""{lot_groups},
 ex as (select c, adm.* from adm join comp on comp.n = node_a),
 pg as (select c, count(*) as pair_count, floor(avg(similarity_score) * 100 + 0.5) / 100 as average_score, max(similarity_score) as top_score, min((idx_a, idx_b)) as first,
  list_sort(list_distinct(flatten(list({parted('matched_evidence')})))) as mf, list_sort(list_distinct(flatten(list(list_concat({parted('mismatched_fields')}, {parted('difference_kinds')}))))) as mm from ex group by c),
 parts as (select c, n, regexp_replace(n, '^[^|]*[|][^|]*[|]', '') as d from comp),
 ng as (select c, count(*) as part_count, arg_min(d, (length(d), lower(d))) as group_name from parts group by c)
 select row_number() over (order by first) as group_id, group_name, part_count, pair_count, average_score, top_score, {o.level('top_score')} as confidence_level, {o.joined('mf')} as matched_fields, {o.joined('mm')} as mismatched_fields,
  part_count || ' parts are connected by ' || pair_count || ' medium/high confidence candidate pair(s). ' || case when len(mf) > 0 then 'Matched fields: ' || array_to_string(mf, ', ') || '.' else 'No shared business fields were available.' end
  || case when len(mm) > 0 then ' Mismatched fields: ' || array_to_string(mm, ', ') || '.' else '' end || ' Review the pair-level evidence before making a master-data decision.' as summary
 from pg join ng using (c)""",
        "labelled_scores": f"{labelled} select pair_id, description_a, description_b, expected_label, score, guess from scored",
        "labelled_metrics": f"""{labelled}, n as (select count(*) filter (where guess = 1 and expected_label = 1) as tp, count(*) filter (where guess = 1 and expected_label = 0) as fp, count(*) filter (where guess = 0 and expected_label = 1) as fn, count(*) filter (where guess = 0 and expected_label = 0) as tn from scored)
 select *, case when tp + fp > 0 then floor(tp / (tp + fp) * 1000 + 0.5) / 1000 else 0 end as precision, case when tp + fn > 0 then floor(tp / (tp + fn) * 1000 + 0.5) / 1000 else 0 end as recall, case when 2 * tp + fp + fn > 0 then floor(2 * tp / (2 * tp + fp + fn) * 1000 + 0.5) / 1000 else 0 end as f1_score from n""",
        "normalize_records": f"{WITH} select rec_idx, npart as normalized_part_no, ndesc as normalized_description, ntext as normalized_text from rec",
        "normalize_documents": f"with a as (select doc_id, {o.normalize('text')} as n from documents), b as (select doc_id, {o.expand('n')} as t from a) select doc_id, len({o.words('t')}) as n_tokens, md5(t) as text_md5 from b",
        "technical_tokens": f"{WITH} select rec_idx, {show(o.TECHNICAL)} from rec",
        "extract_attributes": f"{WITH} select rec_idx, {show(o.ATTRIBUTES, 'at_')} from rec",
        "variant_attributes": f"{WITH} select rec_idx, {', '.join(f'{o.joined(f"v_{n}")} as {n.lower()}' for n in o.VARIANTS)} from rec",
        "record_flags": f"{WITH} select rec_idx, {o.joined('raw_context')} as raw_context, is_generic, family from rec",
        "csv_canonical": "select s_name as PART_NO, case when s_suppkey % 4 in (0, 1) then null else s_name end as DESCRIPTION, cast(s_nationkey as varchar) as TYPE_CODE, cast(null as varchar) as UNIT_MEAS from supplier",
        "profile_validate": f"with pm as ({duckdb_view()}) select count(*) as record_count, {blank('DESCRIPTION')} as empty_descriptions, {blank('HSN_SAC_CODE')} as blank_hsn, {blank('PRODUCT_CATEGORY_ID')} as blank_category, {blank('MASTER_PART_DESCRIPTION')} as blank_master from pm",
        "high_null_fields": f"with pm as ({duckdb_view()}), f as ("
        + " union all ".join(f"select '{f}' as field, {blank(f)} / count(*) as share from pm" for f in ("HSN_SAC_CODE", "HAZARD_CODE", "MASTER_PART_DESCRIPTION"))
        + ") select field, floor(share * 1000 + 0.5) / 10 as percent from f where share >= 0.5",
        "repeated_part_rows": "select cast(coalesce(sum(n), 0) as bigint) as repeated_rows from (select count(*) as n from part group by case when p_partkey % 9 = 0 then '' else p_name end) where n > 1",
        "sensitive_patterns": f"with c as ({' union all '.join(cells)}) select warning_type, cast(sum(n) as bigint) as n_cells, string_agg(c, ', ' order by c) as columns from c where n > 0 group by 1",
        "block_index": f"{PAIRS} select split_part(key, ':', 1) as kind, key, count(*) as n_records, min(rec_idx) as first_record from bl group by 1, 2",
        "candidate_pairs": f"{PAIRS} select * from prs",
        "candidate_pairs_cross_site": f"{WITH}, {o.pair_tables(FIELDS, cross_site=True)} select * from prs",
        "candidate_pairs_capped": f"{WITH}, {o.pair_tables(FIELDS, cross_site=True, cap=vocab.PAIR_LIMIT)} select * from prs",
        "records_without_candidates": f"{PAIRS} select rec_idx, PART_NO from pm where rec_idx not in (select idx_a from prs union select idx_b from prs)",
        "matched_fields": f"{WITH}, {o.pair_tables(FIELDS, cross_site=True)} select idx_a, idx_b, {o.joined(matched)} as matched_fields, {o.joined(mismatched)} as mismatched_fields from {o.both()}",
        "set_scores": f"{PAIRS} select idx_a, idx_b, {o.technical_score()} as technical_score, {o.structured_score()} as structured_score, {o.business_score(FIELDS)} as business_score from {o.both()}",
        "tfidf_pairs": f"{PAIRS}, {texts}, {o.gram_cosine('select ta, tb from sp')} select ta, tb, tfidf_score from cosines",
        "part_no_similarity": f"with s as (select s_suppkey as i, s_nationkey as n, replace({o.expand(o.normalize('s_name'))}, ' ', '') as t from supplier), p as (select a.i as idx_a, b.i as idx_b, a.t as ta, b.t as tb from s a join s b on a.n = b.n and a.i < b.i) "
        f"select idx_a, idx_b, case when ta = '' or tb = '' then 0 else {o.round2(f'200.0::double * {o.common_length("ta", "tb")} / (length(ta) + length(tb))')} end as part_no_similarity from p",
        "fuzzy_pairs": f"{PAIRS}, {texts}, {o.fuzzy_scores('select ta, tb from sp')} select ta, tb, fuzzy_score from fz",
        "classic_results": f"{PAIRS}, {o.classic_decisions(FIELDS)} select * from decided",
        "evidence_results": f"{PAIRS}, {o.evidence_decisions(FIELDS)} select * from decided",
        "evidence_status_summary": f"{PAIRS}, {o.evidence_decisions(FIELDS)} select coalesce(business_status, 'TOTAL') as status, count(*) as n from decided group by rollup (business_status)",
        "classic_decisions": f"{lots}, {o.classic_decisions(MIXED_FIELDS)} select * from decided",
        "classic_decisions_cross_site": f"{lots}, {o.classic_decisions(MIXED_FIELDS, vocab.SCAN_MODES[1])} select * from decided",
        "evidence_decisions": f"{lots}, {o.evidence_decisions(MIXED_FIELDS)} select * from decided",
        "evidence_decisions_cross_site": f"{lots}, {o.evidence_decisions(MIXED_FIELDS[1:], cross_site=True)} select * from decided",
        "classic_guards": f"{PAIRS} {o.classic_guards()}",
        "evidence_guards": f"{PAIRS} {o.evidence_guards()}",
        "guard_status_summary": f"{guard_rows} select coalesce(status, 'TOTAL') as status, count(*) as n from gd where status is not null group by rollup (status)",
        "review_filter": f"{guard_rows} select idx_a, idx_b, score as similarity_score, status as business_status from gd where score >= 46 and status in ({', '.join(map(o.quoted, vocab.REVIEW_STATUSES))})",
        "produced_and_kept": f"{guard_rows} select status, count(*) as produced, count(*) filter (where score >= 50 and status in ({', '.join(map(o.quoted, vocab.REVIEW_STATUSES))})) as kept from gd where status is not null group by status",
        "group_members": f"{grouped} select n as node, c as component from comp",
        "duplicate_groups": f"""{grouped},
 pg as (select c, count(*) as pair_count, floor(avg(similarity_score) * 100 + 0.5) / 100 as average_score, max(similarity_score) as top_score, min((idx_a, idx_b)) as first from adm join comp on comp.n = node_a group by c),
 parts as (select c, n, regexp_replace(n, '^[^|]*[|][^|]*[|]', '') as d from comp),
 ng as (select c, count(*) as part_count, arg_min(d, (length(d), lower(d))) as group_name from parts group by c)
 select row_number() over (order by first) as group_id, group_name, part_count, pair_count, average_score, top_score,
  case when top_score >= 90 then 'HIGH' when top_score >= 75 then 'MEDIUM' when top_score >= 60 then 'LOW' else 'IGNORE' end as confidence_level,
  part_count || ' parts are connected by ' || pair_count || ' medium/high confidence candidate pair(s). No shared business fields were available. Review the pair-level evidence before making a master-data decision.' as summary
 from pg join ng using (c)""",
        "export_rows": f"""{PAIRS}, gd as ({o.classic_guards()})
 select a.PART_NO as part_no_a, '' as description_a, '''=' || b.DESCRIPTION as description_b, cast(gd.score as varchar) as similarity_score, cast(gd.score as varchar) as score, gd.explanation as reason,
  cast(to_json({matched}) as varchar) as matched_fields, array_to_string({matched}, '; ') as matched_evidence, cast(to_json(a.at_color) as varchar) as application_context_a,
  cast(to_json({variants}) as varchar) as variant_attributes_a, '' as review_status
 from gd join rec a on a.rec_idx = gd.idx_a join rec b on b.rec_idx = gd.idx_b where gd.status is not null""",
        "feedback_latest": "select o_custkey as candidate_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as decision, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as feedback_id from orders group by 1",
        "evaluation_metrics": "with c as (select count(*) filter (where quality = 0 and toxic = 1) as tp, count(*) filter (where quality = 0 and toxic = 0) as fp, count(*) filter (where quality <> 0 and toxic = 1) as fn, count(*) filter (where quality <> 0 and toxic = 0) as tn from labels) "
        "select *, case when tp + fp > 0 then floor(tp / (tp + fp) * 1000 + 0.5) / 1000 else 0 end as precision, case when tp + fn > 0 then floor(tp / (tp + fn) * 1000 + 0.5) / 1000 else 0 end as recall, case when 2 * tp + fp + fn > 0 then floor(2 * tp / (2 * tp + fp + fn) * 1000 + 0.5) / 1000 else 0 end as f1_score from c",
        "field_catalogue": "select * from (values " + ", ".join(f"({o.quoted(f)}, {o.quoted(d)}, {str(r).lower()}, {o.quoted(vocab.FIELD_ROLES[f]) if f in vocab.FIELD_ROLES else 'null'})" for f, d, r in vocab.FIELDS) + ") v(field, display, required, role)",
    }

