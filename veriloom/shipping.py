"""Sends the package's own code to the executors of a session."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session, once for each Spark application.

    Executors, also those that come later, fetch it from Spark; so Python
    functions find their modules wherever the driver was started.
    """
    context = spark.sparkContext
    if _sent.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    data = buffer.getvalue()
    target = os.path.join(tempfile.mkdtemp(prefix="veriloom-code-"), f"veriloom-{hashlib.sha256(data).hexdigest()[:16]}.zip")
    with open(target, "wb") as out:
        out.write(data)
    context.addPyFile(target)
    _sent["application"] = context.applicationId
