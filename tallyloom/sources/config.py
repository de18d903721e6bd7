"""Host-side files: configurations, templates, backups, rendered model files, provenance."""

from __future__ import annotations

import datetime
import itertools
import os
import subprocess

from pyspark.sql import SparkSession

from tallyloom.sources.jsonl import _fs


def require_keys(config: dict, keys: list[str]) -> dict:
    """Dotted keys must be there."""
    missing = []
    for k in keys:
        at: object = config
        for part in k.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            missing.append(k)
    if missing:
        raise KeyError(f"missing configuration keys: {', '.join(missing)}")
    return config


def load_yaml(spark: SparkSession, path: str, keys: list[str]) -> dict:
    """S13; needs a YAML library."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return require_keys(yaml.safe_load(text) or {}, keys)


def load_text(spark: SparkSession, path: str, needs: str = "") -> str:
    """One template file, which must contain a given piece."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if needs not in text:
        raise ValueError(f"{path} lacks {needs!r}")
    return text


def provenance() -> dict[str, str]:
    """What a run's rows may carry about where they come from."""
    try:
        rev = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        rev = "unknown"
    return {"revision": rev, "user": os.environ.get("USER", "unknown"), "at": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")}


def backup(spark: SparkSession, path: str, stamp: str) -> str:
    """A copy beside the file, before it is rewritten."""
    fs, source = _fs(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = f"{path}.{stamp}.bak"
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, jvm.org.apache.hadoop.fs.Path(target), False, conf)
    return target


def render_variants(template: str, **choices: list[str]) -> dict[tuple[str, ...], str]:
    """A file a combination of values."""
    names = list(choices)
    return {combo: template.format(**dict(zip(names, combo))) for combo in itertools.product(*choices.values())}


def resume_state(outputs: int, recorded: int | None, digest: str | None, now: str | None) -> str:
    """``empty``, ``clean`` or ``mismatch`` of an earlier run's outputs."""
    if not outputs and recorded is None:
        return "empty"
    return "clean" if outputs == recorded and digest == now else "mismatch"


def targets_with_baseline(names: list[str], paths: list[str], baseline: str | None = None) -> list[tuple[str, str | None]]:
    """Names with paths, after an optional baseline without one."""
    if len(names) != len(paths):
        raise ValueError(f"{len(names)} names for {len(paths)} paths")
    return ([(baseline, None)] if baseline else []) + list(zip(names, paths))
