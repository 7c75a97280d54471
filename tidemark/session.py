"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Partition counts are left to adaptive execution: it starts from
# spark.sql.shuffle.partitions and merges or splits towards the advisory size.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # As in other JSON readers, the last of a repeated key counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_local_root: str | None = None
_made: dict[str, list[str]] = {}


def build_session(
    app_name: str = "tidemark", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def session_settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for what runs inside; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder path below the shared folder named by ``spark.checkpoint.dir``.

    Executors must all see it, so a machine-local temporary folder is used only
    when the setting is absent *and* the master is local.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="tidemark-")
        root = _local_root
    path = f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.conf.get("spark.app.id", ""), []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders of this session. Results that still read them can then not be used any more."""
    context = spark.sparkContext
    for path in _made.pop(spark.conf.get("spark.app.id", ""), []):
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
