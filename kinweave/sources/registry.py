"""Registries of programmes and field vocabularies from TOML, JSON or (where installed) YAML files."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FRAME = "code string, name_en string, name_ko string, source_url string, roster_count int, included_count int, decision string, declared map<string,int>"


def load(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".toml"):
        return tomllib.loads(text)
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML registries need the yaml package; use TOML or JSON") from e
    return yaml.safe_load(text)


def frames(spark: SparkSession, doc: dict) -> DataFrame:
    """One row per programme. A programme without a code or recorded decision, or a repeated code, is an error."""
    rows, seen = [], set()
    for f in doc.get("frames", []):
        code = f.get("code")
        decision = (f.get("eligibility") or {}).get("decision")
        if not code or code in seen or decision is None:
            raise ValueError(f"programme {code!r}: code missing or repeated, or no decision recorded")
        seen.add(code)
        declared = {str(k): int(v["size"] if isinstance(v, dict) else v) for k, v in (f.get("roster_size_declared") or {}).items()}
        rows.append((code, f.get("name_en"), f.get("name_ko"), f.get("source_url"), f.get("roster_count"), f.get("included_count"), decision, declared))
    return spark.createDataFrame(rows, FRAME)
