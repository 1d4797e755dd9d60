"""Stored scans, candidates, warnings and reviews as Parquet tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCANS = "scan_id string, name string, status string, record_count long, total_candidates long, warnings_count long, threshold double, scan_mode string, started_at timestamp, completed_at timestamp"
WARNINGS = "scan_id string, warning_type string, message string, record_reference string, created_at timestamp"
FEEDBACK = "scan_id string, idx_a long, idx_b long, decision string, reviewer string, comment string, created_at timestamp, feedback_id string"
#: Columns that all candidates have; the others depend on the engine.
CANDIDATES = "idx_a long, idx_b long, similarity_score double, confidence_level string, business_status string, explanation string, review_status string, scan_id string"
DECISIONS = ("DUPLICATE", "NOT_DUPLICATE", "UNSURE")


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Store:
    """Append-only tables under one folder; the latest row of a scan is its state, candidates are partitioned by scan."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def start_scan(self, name: str | None, threshold: float, scan_mode: str) -> str:
        scan_id = uuid.uuid4().hex
        self._append("scans", self.spark.createDataFrame([(scan_id, (name or "").strip() or "Duplicate scan", "RUNNING", None, None, None, float(threshold), scan_mode, now(), None)], SCANS))
        return scan_id

    def finish_scan(self, scan_id: str, status: str, record_count: int | None = None, total_candidates: int | None = None, warnings_count: int | None = None) -> None:
        """Appends the final state: COMPLETED or FAILED, with its time."""
        if status not in ("COMPLETED", "FAILED"):
            raise ValueError("a scan ends as COMPLETED or FAILED")
        old = self.scans().where(F.col("scan_id") == scan_id).first()
        row = (scan_id, old["name"], status, record_count, total_candidates, warnings_count, old["threshold"], old["scan_mode"], old["started_at"], now())
        self._append("scans", self.spark.createDataFrame([row], SCANS))

    def save_candidates(self, scan_id: str, found: DataFrame) -> None:
        found.withColumn("scan_id", F.lit(scan_id)).write.mode("append").partitionBy("scan_id").parquet(f"{self.path}/candidates")

    def save_warnings(self, scan_id: str, warnings: list[dict]) -> None:
        if warnings:
            rows = [(scan_id, w["warning_type"], w["message"], w.get("record_reference"), now()) for w in warnings]
            self._append("warnings", self.spark.createDataFrame(rows, WARNINGS))

    def add_feedback(self, scan_id: str, idx_a: int, idx_b: int, decision: str, reviewer: str | None = None, comment: str | None = None) -> bool:
        """Appends a review of a stored candidate; False if there is none."""
        if decision not in DECISIONS:
            raise ValueError(f"decision must be one of {', '.join(DECISIONS)}")
        if self.candidates(scan_id).where((F.col("idx_a") == idx_a) & (F.col("idx_b") == idx_b)).isEmpty():
            return False
        self._append("feedback", self.spark.createDataFrame([(scan_id, idx_a, idx_b, decision, reviewer, comment, now(), uuid.uuid4().hex)], FEEDBACK))
        return True

    def scans(self) -> DataFrame:
        """Latest state of every scan, newest first."""
        latest = Window.partitionBy("scan_id").orderBy(F.col("completed_at").desc_nulls_last())
        rows = self._read("scans", SCANS).withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")
        return rows.orderBy(F.desc("started_at"))

    def candidates(self, scan_id: str) -> DataFrame:
        """Candidates of a scan with their current review; only the partition of the scan is read."""
        # the folder of the scan alone is opened, so other scans may have other columns; one without candidates has none
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/candidates").parquet(f"{self.path}/candidates/scan_id={scan_id}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], CANDIDATES)
        reviews = latest_feedback(self._read("feedback", FEEDBACK).where(F.col("scan_id") == scan_id), ["idx_a", "idx_b"])
        own = reviews.select("idx_a", "idx_b", F.col("decision").alias("d"), F.col("reviewer").alias("reviewed_by"), F.col("created_at").alias("reviewed_at"))
        return rows.join(own, ["idx_a", "idx_b"], "left").withColumn("review_status", F.coalesce("d", "review_status")).drop("d")

    def ranked_candidates(self, scan_id: str) -> DataFrame:
        return self.candidates(scan_id).orderBy(F.desc("similarity_score"), "idx_a", "idx_b")

    def warnings(self, scan_id: str) -> DataFrame:
        return self._read("warnings", WARNINGS).where(F.col("scan_id") == scan_id)

    def columns(self) -> dict[str, list[str]]:
        """The tables that are written here, with their columns; those of candidates are those of the scans stored so far."""
        names = lambda schema: [c.split()[0] for c in schema.split(", ")]
        try:
            found = self.spark.read.parquet(f"{self.path}/candidates").columns
        except Exception as error:
            if not any(kind in str(error) for kind in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            found = [c.split()[0] for c in CANDIDATES.split(", ")]
        return {"scans": names(SCANS), "candidates": found, "warnings": names(WARNINGS), "feedback": names(FEEDBACK)}

    def summary(self) -> dict:
        """Counts of scans, candidates and reviews, and the newest scan."""
        try:
            found = self.spark.read.parquet(f"{self.path}/candidates").count()
        except Exception as error:
            if not any(kind in str(error) for kind in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            found = 0
        newest = self.scans().limit(1).collect()
        return {"scans": self.scans().count(), "candidates": found, "feedback": self._read("feedback", FEEDBACK).count(), "latest_scan": newest[0].asDict() if newest else None}


def latest_feedback(feedback: DataFrame, keys: list[str], order=("created_at", "feedback_id")) -> DataFrame:
    """The last review of each candidate."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return feedback.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
