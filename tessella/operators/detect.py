"""What a file holds: ids, profiles, columns worth showing; and a project's configuration."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words in names of columns that no dashboard shows, and suffixes of extraction files.
HIDDEN_WORDS = ("date", "time", "timestamp", "calendar_year", "years_since_birth", "record_id", "patient_id", "id", "data_source")
ID_PATTERN = re.compile(r"(?:^|_)(?:patient|subject|person|record|participant|case)_?(?:id|key|num|number)$|^mrn$|^pid$", re.I)
SECRETS = re.compile(r"key|token|secret|password", re.I)


def shown_columns(columns: list[str]) -> list[str]:
    """Columns whose names have none of the hidden words as whole words."""
    words = lambda c: f"_{re.sub('[^a-z0-9]+', '_', c.lower())}_"
    return [c for c in columns if not any(f"_{w}_" in words(c) for w in HIDDEN_WORDS)]


def id_candidates(frames: dict[str, DataFrame], least: float = 0.9) -> list[tuple[str, float]]:
    """(column, score), best first: a telling name, presence in several files, values that are nearly unique; one pass a file."""
    score: dict[str, float] = {}
    for df in frames.values():
        able = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "int", "bigint")]
        if not able:
            continue
        row = df.agg(F.count("*").alias("_n"), *(F.approx_count_distinct(f"`{c}`").alias(c) for c in able)).first()
        for c in able:
            unique = row["_n"] and row[c] / row["_n"] >= least
            score[c] = score.get(c, 0.0) + 2.0 * bool(ID_PATTERN.search(c)) + 0.5 * bool(unique) + 0.25
    return sorted(((c, s) for c, s in score.items() if s >= 0.75), key=lambda x: (-x[1], x[0]))


def id_column(path: str, by_file: dict[str, str], default: str) -> str:
    """The id column set for a file's name, else for its stem, else the default."""
    name = os.path.basename(path)
    return by_file.get(name) or by_file.get(name.rsplit(".", 1)[0]) or default


def profile(df: DataFrame, rows: int = 3) -> dict:
    return {"rows": df.count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema}, "first": [r.asDict() for r in df.limit(rows).collect()]}


def category_of_stem(stem: str, known: list[str]) -> str:
    """The longest known category that ends the stem, else the stem."""
    return max((k for k in known if stem == k or stem.endswith("_" + k)), key=len, default=stem)


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration: missing paths and unknown keys."""
    known = {"input_paths", "output_dir", "column_mapping", "column_mappings", "min_cell", "max_rows", "privacy_mode", "id_columns", "api_key"}
    out = [f"unknown setting {k}" for k in sorted(set(config) - known)]
    return out + [f"missing path {p}" for p in config.get("input_paths", []) if "://" not in p and not Path(p).exists()]


def save_config(config: dict, path: str) -> None:
    """Written beside and renamed, without secrets."""
    beside = Path(f"{path}.part")
    beside.write_text(json.dumps({k: v for k, v in config.items() if not SECRETS.search(k)}, indent=2, sort_keys=True))
    beside.replace(path)


def read_ontologies(folder: str) -> dict[str, dict]:
    """Ontologies by id, from ``*/ontology.yaml``; needs a YAML reader."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading ontologies needs a YAML package") from e
    found = [yaml.safe_load(p.read_text()) | {"folder": str(p.parent)} for p in sorted(Path(folder).glob("*/ontology.yaml"))]
    return {str(o.get("id", Path(o["folder"]).name)): o for o in found}


def staging_items(core: list[str], own: dict[str, list[str]], schema: str, aliases: dict[str, str] | None = None) -> list[str]:
    """Items to stage by: core, then the schema's, each once."""
    schema = (aliases or {}).get(schema, schema)
    return list(dict.fromkeys([*core, *own.get(schema, [])]))


def field_block(item: dict, codes: list[tuple[str, str]] = (), most: int = 20) -> str:
    """A prompt's lines for one field."""
    lines = [f"- {item['name']} ({item['id']}): {item.get('description', '')}".rstrip(": ")]
    lines += [f"  format: {item['format']}"] if item.get("format") else []
    return "\n".join(lines + [f"  {c} = {d}" for c, d in list(codes)[:most]])


def state_block(results: list[tuple[str, str, float]]) -> str:
    """A prompt's lines for what is already known with any confidence."""
    return "\n".join(f"- {f}: {v} ({c:.2f})" for f, v, c in results if c and c > 0)


def tumor_context(diagnoses: list[str], index: int) -> str:
    return f"Diagnosis {index + 1} of {len(diagnoses)}: {diagnoses[index]}" if len(diagnoses) > 1 else ""


def code_block(hits: dict[str, list[tuple[str, str]]]) -> str:
    """Markdown of vocabulary hits; empty if there are none."""
    return "\n\n".join(f"### {name}\n" + "\n".join(f"- `{c}` {d}" for c, d in found) for name, found in hits.items() if found)
