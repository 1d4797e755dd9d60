"""A scan from records to candidates: validate, enrich once, block, join, decide, filter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.attributes import enrich
from ..operators import blocking, classic, evidence, results
from ..operators.decisions import scan_mode
from ..operators.reuse import reused
from ..operators.similarity import spread
from ..operators.validation import usable_fields
from ..sources.ingest import canonical_columns, canonical_fields, with_description, with_index
from ..sources.store import Store


@dataclass
class Scan:
    """What a scan found: all decided candidates (lazy), the fields it used, and warnings."""

    candidates: DataFrame
    fields: list[str]
    warnings: list[dict] = field(default_factory=list)


def decided_pairs(records: DataFrame, fields=(), *, engine: str = "classic", mode: str | None = None, most: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Decided pairs of records that have a description, and a warning if ``most`` cut them; ``fields`` must be usable columns."""
    mode = scan_mode(mode)
    cross_site = mode != vocab.SCAN_MODES[0]
    enriched = reused(enrich(spread(with_index(with_description(records)), "rec_idx")), "records")
    pairs, warnings = blocking.limited_pairs(enriched, fields, cross_site=cross_site, most=most)
    pairs = pairs.select("idx_a", "idx_b")  # keys, if the limit needed them, go no further
    if most is not None:  # only the records of the admitted pairs go on
        pairs = reused(pairs, "pairs")
        enriched = reused(enriched.join(pairs.select(F.explode(F.array("idx_a", "idx_b")).alias("rec_idx")).distinct(), "rec_idx", "left_semi"), "paired-records")
    if engine == "classic":
        return classic.decide(pairs, enriched, fields, mode), warnings
    if engine == "evidence":
        return evidence.decide(pairs, enriched, fields, cross_site, mode), warnings
    raise ValueError("engine must be classic or evidence")


def run_scan(records: DataFrame, fields=(), *, engine: str = "classic", mode: str | None = None, threshold: float = 75.0, statuses=None, most: int | None = None) -> Scan:
    """Scans records.  Everything up to the candidates is one lazy plan; ``most`` caps the pairs as an interactive scan does.

    The cross-site modes compare records of different sites.  Without a status list the classic engine keeps all
    statuses and the evidence engine those that need a review.
    """
    records = canonical_columns(records)
    if "REC_IDX" in records.columns:
        records = records.withColumnRenamed("REC_IDX", "rec_idx")
    wanted = canonical_fields(fields)
    used, warnings = usable_fields(records, wanted)
    decided, cut = decided_pairs(records, used, engine=engine, mode=mode, most=most)
    if statuses is None and engine == "evidence":
        statuses = vocab.REVIEW_STATUSES
    return Scan(results.kept(results.candidates(decided), threshold, statuses), used, warnings + cut)


def run_stored_scan(store: Store, records: DataFrame, fields=(), *, name: str | None = None, threshold: float = 75.0, mode: str | None = None, **options) -> str:
    """Runs a scan and stores it; its last state is COMPLETED, or FAILED if anything was raised."""
    scan_id = store.start_scan(name, threshold, scan_mode(mode))
    try:
        scan = run_scan(records, fields, threshold=threshold, mode=mode, **options)
        store.save_candidates(scan_id, scan.candidates)
        store.save_warnings(scan_id, scan.warnings)
        store.finish_scan(scan_id, "COMPLETED", records.count(), store.candidates(scan_id).count(), len(scan.warnings))
    except Exception:
        store.finish_scan(scan_id, "FAILED")
        raise
    return scan_id
