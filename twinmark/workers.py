"""What Python workers need: this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_twinmark_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        tree = os.path.join(folder, "tree")
        shutil.copytree(package, os.path.join(tree, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        # the file server reads it as long as the context lives, so it goes to the context's own folder
        sc.addPyFile(shutil.make_archive(os.path.join(sc._temp_dir, "twinmark-workers"), "zip", tree))
    sc._twinmark_shipped = True
