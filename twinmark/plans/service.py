"""What an application calls: liveness, groups and export of a stored scan, a load test."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators.groups import MINIMUM, duplicate_groups
from ..sources.export import export_csv
from ..sources.ingest import fingerprint, synthetic
from ..sources.store import Store
from .scan import run_stored_scan


def ping(spark: SparkSession) -> dict:
    """Whether the session answers."""
    return {"status": "ok", "rows": spark.range(1).count()}


def scan_groups(store: Store, scan_id: str, minimum: float = MINIMUM, nested: bool = False) -> DataFrame:
    """Duplicate groups of a stored scan, the best and largest first; ``nested`` adds their parts and pairs."""
    return duplicate_groups(store.candidates(scan_id), minimum, nested).orderBy("top_score", "part_count", "group_id", ascending=[False, False, True])


def export_scan(store: Store, scan_id: str, path: str, single_file: bool = False) -> None:
    """Writes the candidates of a stored scan as CSV, the most similar first within each file."""
    export_csv(store.candidates(scan_id).sortWithinPartitions("similarity_score", ascending=False), path, single_file)


def write_synthetic(spark: SparkSession, n: int, path: str, **rates) -> None:
    """Writes ``n`` made-up records as CSV with a header, part files in parallel."""
    synthetic(spark, n, **rates).drop("rec_idx").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def kept_data(store: Store, path: str | None = None) -> DataFrame:
    """(table, column) of everything a store keeps, and the fingerprint of the input at ``path`` if one is given.

    Read from the store's own schemas: what is not listed, the input's raw rows above all, is not kept.
    """
    rows = store.spark.createDataFrame([(name, column) for name, columns in store.columns().items() for column in columns], "`table` string, `column` string")
    if path is None:
        return rows
    return rows.unionAll(fingerprint(store.spark, path).select(F.lit("input"), F.concat(F.lit("sha256:"), F.col("file_sha256"))))


def load_test(store: Store, n: int = 500, duplicate_rate: float = 0.15, variation_rate: float = 0.3, threshold: float = 70.0, most: int | None = vocab.PAIR_LIMIT) -> dict:
    """Scans ``n`` made-up records and reports time and counts."""
    if not 10 <= n:
        raise ValueError("a load test needs at least 10 records")
    records = synthetic(store.spark, n, duplicate_rate, variation_rate)
    began = time.perf_counter()
    scan_id = run_stored_scan(store, records, ["CONTRACT", "UNIT_MEAS", "PRIME_COMMODITY"], name=f"Synthetic load test {n}", threshold=threshold, most=most)
    return {
        "scan_id": scan_id,
        "record_count": n,
        "processing_time_seconds": round(time.perf_counter() - began, 3),
        "candidates_found": store.candidates(scan_id).count(),
        "warnings_count": store.warnings(scan_id).count(),
    }
