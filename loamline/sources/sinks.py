"""Where results go that are no lake tables: record tables replaced together, a corpus in local files, reports of evaluations."""

from __future__ import annotations

import hashlib
import json
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = jvm_path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm_path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place by a rename, so that nobody reads half of it."""
    fs, target, jvm_path = _place(spark, path)
    part = jvm_path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def _loads(spark: SparkSession, root: str) -> list[int]:
    fs, d, _ = _place(spark, f"{root}/_loads")
    names = [f.getPath().getName() for f in fs.listStatus(d)] if fs.exists(d) else []
    return sorted(int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit())


def replace_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Replaces all ``tables`` below ``root`` at once and gives their rows. Readers see all old or all new ones, and a load that ends early changes nothing."""
    load = max(_loads(spark, root), default=0) + 1
    folder = f"{load:08d}-{uuid.uuid4().hex[:8]}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{folder}/{name}").count()
    fs, d, _ = _place(spark, f"{root}/_loads")
    fs.mkdirs(d)
    _write_text(spark, f"{root}/_loads/{load:08d}.json", json.dumps({"folder": folder, "rows": counts}))
    return counts


def loaded_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last whole load; none before the first."""
    done = _loads(spark, root)
    if not done:
        return {}
    fs, p, _ = _place(spark, f"{root}/_loads/{done[-1]:08d}.json")
    stream = fs.open(p)
    try:
        load = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return {name: spark.read.parquet(f"{root}/{load['folder']}/{name}") for name in load["rows"]}


def write_corpus(documents: Iterable[tuple[str, bytes, dict[str, str]]], out: str | Path) -> Path:
    """Files of (key, data, metadata) below ``out``/raw, in place of what was there, and ``manifest.json``, the path of which it returns. Keys that lead out of the folder are refused."""
    raw, listed = Path(out) / "raw", []
    if raw.exists():
        shutil.rmtree(raw)
    raw.mkdir(parents=True)
    for key, data, metadata in documents:
        path = raw / key
        if not path.resolve().is_relative_to(raw.resolve()):
            raise ValueError(f"key leads out of the folder: {key}")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        listed.append({"key": key, "sha256": hashlib.sha256(data).hexdigest(), **metadata})
    manifest = Path(out) / "manifest.json"
    manifest.write_text(json.dumps(listed, indent=2) + "\n", encoding="utf-8")
    return manifest


def write_report(path: str, metrics: DataFrame, results: DataFrame, **about) -> None:
    """A report below ``path``: ``results`` as JSON lines, and ``summary.json`` with ``metrics`` (one row) and what else is ``about`` the run, which is written last."""
    spark = results.sparkSession
    results.write.json(f"{path}/results")
    _write_text(spark, f"{path}/summary.json", json.dumps({**about, "metrics": metrics.first().asDict()}, indent=2, default=str))
