"""Spark sessions, and shipping this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch: batches of 10000 rows of whole texts fill a worker as the texts, or the rows of a task, grow.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def session(app: str = "postroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return ship(builder.config(map=settings).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make ``import postroom`` work on every executor, once for each context, and bound Arrow batches by bytes.

    The package goes as a zip through Spark's own file server, so executors need
    no installation and no path in common with the driver.
    """
    if spark.conf.get(BATCH[0], None) is None:  # what a user has set stays
        spark.conf.set(*BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_postroom_shipped", False):
        return spark
    home = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="postroom-")) / "postroom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, os.path.join("postroom", f.relative_to(home)))
    sc.addPyFile(str(target))
    sc._postroom_shipped = True
    return spark
