"""Writers: every one is a distributed write of a whole DataFrame."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastleg.sources.files import BOM


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    from lastleg.operators.lineage import shared_folder

    return f"{shared_folder(spark)}/lastleg-{name}-{uuid.uuid4().hex}"


def write_csv(frame: DataFrame, path: str, if_absent: bool = False) -> None:
    """Part files that each start with a byte order mark and the header. Nothing is written over if ``if_absent``."""
    first, *others = frame.columns
    marked = frame.select(F.col(f"`{first}`").alias(BOM + first), *(F.col(f"`{c}`") for c in others))
    marked.write.mode("ignore" if if_absent else "overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(frame: DataFrame, path: str, by: list[str] | None = None, if_absent: bool = False) -> None:
    """ZSTD parquet, in one folder for each value of ``by``; only the folders that occur are replaced."""
    writer = frame.write.mode("ignore" if if_absent else "overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def point_features(frame: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature in each row; rows without coordinates have none."""
    others = [c for c in frame.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*others).alias("properties"), geometry.alias("geometry"))
    return frame.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(frame: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """Part files with one feature in each line, which tools read as a sequence."""
    point_features(frame, lon, lat).write.mode("overwrite").text(path)


def write_zones(frame: DataFrame, zone: str, zones: list, path: str) -> DataFrame:
    """(zone, status, rows, error): every zone is written on its own, so a failure keeps what the others have; the status is written too."""
    spark, rows = frame.sparkSession, []
    for z in zones:
        try:
            frame.where(F.col(zone) == z).write.mode("overwrite").parquet(f"{path}/rows/{zone}={z}")
            rows.append((z, "completed", spark.read.parquet(f"{path}/rows/{zone}={z}").count(), None))
        except Exception as why:  # noqa: BLE001  whatever a zone fails by is its status
            rows.append((z, "failed", 0, str(why).split("\n")[0][:200]))
        status = spark.createDataFrame(rows, f"{zone} int, status string, rows bigint, error string")
        status.coalesce(1).write.mode("overwrite").parquet(f"{path}/status")
    return status


def provenance(settings: dict, inputs: list[str]) -> dict:
    """What a result was made from: hashes of the settings and of the input files, the code's commit, and the versions in use."""
    import platform
    import subprocess

    def git(*words: str) -> str | None:
        done = subprocess.run(["git", *words], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    def digest(path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    changed = git("status", "--porcelain")
    return {
        "settings_sha256": payload_hash(settings),
        "inputs_sha256": {p: digest(p) for p in inputs},
        "commit": git("rev-parse", "HEAD"),
        "branch": git("rev-parse", "--abbrev-ref", "HEAD"),
        "changed": None if changed is None else bool(changed),
        "python": platform.python_version(),
        "platform": platform.platform(),
    }


def write_json(payload: dict, path: str) -> None:
    """A JSON file that is either whole or absent: written beside its place, then renamed."""
    import os

    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


#: Tables that only the fullest level of detail writes.
DETAIL = {"routing_detail"}


def chosen_outputs(tables: dict[str, DataFrame], audit: str = "summary", profile: bool = False) -> dict[str, DataFrame]:
    """The audit tables that a level of detail writes (none, summary, full); stage times only if asked for."""
    if audit not in ("none", "summary", "full"):
        raise ValueError(f"unknown level {audit}")
    if audit == "none":
        kept = {}
    else:
        kept = {k: v for k, v in tables.items() if k != "stages" and (audit == "full" or k not in DETAIL)}
    return kept | ({"stages": tables["stages"]} if profile and "stages" in tables else {})


def payload_hash(payload: dict) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
