"""Making the package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the job's Python files, once per application; Spark serves it to every executor.

    Where it is installed on all nodes this changes nothing; elsewhere tasks could not import it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):  # already imported from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ephyspark-"), "ephyspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ephyspark", os.path.relpath(full, home)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a temporary one on a local master where none is set."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    folder = named.get() if named.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return f"{folder}/{uuid.uuid4().hex}"
