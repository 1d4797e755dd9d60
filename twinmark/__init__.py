"""Record linkage and duplicate detection for item master data on Spark."""
