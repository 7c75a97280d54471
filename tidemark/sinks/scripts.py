"""Numbered table definitions, run in order and once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.batches import written

LOG_SCHEMA = "name string, script string, digest string, loaded_at timestamp"
_VALUE = re.compile(r"\$\{(\w+)\}")


def rendered(script: str, values: Mapping[str, str]) -> str:
    """A script with ``${NAME}`` replaced by the value of that name; a name without a value raises."""
    missing = sorted(set(_VALUE.findall(script)) - set(values))
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return _VALUE.sub(lambda m: values[m[1]], script)


def script_log(spark: SparkSession, log: str) -> DataFrame:
    """Rows ``(name, script, digest, loaded_at)``, one for each script that was run; loads for ``stale_partitions``."""
    return written(spark, log, LOG_SCHEMA)


def read_scripts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Text of every script ``<folder>/<name>/<number>_<what>.ddl`` by its path below the folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ddl").text(folder, wholetext=True)
    path = F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/", -2)
    return {r.path: r.value for r in files.select(path.alias("path"), "value").collect()}


def run_scripts(
    spark: SparkSession, scripts: Mapping[str, str], log: str, values: Mapping[str, Mapping[str, str]] | None = None
) -> list[str]:
    """Run the scripts (text by ``<name>/<script>``) that are new or changed; what was run, in order.

    A script is one statement. ``values`` gives the values of each name's scripts. Scripts of a name run in the order
    of their file names. A script runs again only if its text with values differs from what ran last. Each is logged
    once it has run, so that after a failure, which ends the run, the next one goes on with the failed script. The
    scripts and their log are as small as the program that holds them.
    """
    newest = script_log(spark, log).groupBy("name", "script").agg(F.max_by("digest", "loaded_at").alias("digest"))
    ran = {f"{r.name}/{r.script}": r.digest for r in newest.collect()}
    done = []
    for place, text in sorted(scripts.items()):
        name, script = place.split("/")
        statement = rendered(text, (values or {}).get(name, {})).strip().rstrip(";")
        digest = hashlib.sha256(statement.encode()).hexdigest()
        if ran.get(place) == digest:
            continue
        spark.sql(statement)
        entry = spark.range(1).select(
            F.lit(name).alias("name"), F.lit(script).alias("script"), F.lit(digest).alias("digest"),
            F.current_timestamp().alias("loaded_at"),
        )
        entry.write.mode("append").parquet(log)
        done.append(place)
    return done
