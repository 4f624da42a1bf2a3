"""Settings: typed defaults, nested overrides, environment strings."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
#: Section, name, default, least, most (None: no range). Credentials belong to the translator plugin and have no place here.
SETTINGS = (
    ("translate", "max_tokens", 65536, 1024, 131072),
    ("translate", "temperature", 0.3, 0, 2),
    ("translate", "thinking", False, None, None),
    ("translate", "effort", "high", None, None),
    ("parse", "backend", "hybrid", None, None),
    ("parse", "effort", "medium", None, None),
    ("parse", "timeout", 1800, 60, 7200),
    ("chunk", "target_tokens", 30000, 1000, 100000),
    ("chunk", "max_paragraphs", 200, 10, 500),
    ("chunk", "min_retention", 0.95, 0, 1),
    ("run", "parallel", True, None, None),
    ("run", "workers", 64, 1, 256),
    ("run", "parsers", 1, 1, 8),
    ("run", "max_chapter_pages", 100, 0, 9999),
    ("run", "integrity", True, None, None),
)
DEFAULTS: dict = {}
for _section, _name, _value, _, _ in SETTINGS:
    DEFAULTS.setdefault(_section, {})[_name] = _value


def load(text: str | None) -> dict:
    """Defaults under what a JSON text says; what is no object, or broken, is ignored."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        given = {}
    given = given if isinstance(given, dict) else {}
    return {s: {**own, **{k: v for k, v in (given.get(s) or {}).items() if k in own}} for s, own in DEFAULTS.items()}


def read(path: str) -> dict:
    """Settings from a file, made there with the defaults where it is missing or broken."""
    try:
        with open(path) as f:
            text = f.read()
        whole = isinstance(json.loads(text), dict)
    except (OSError, ValueError):
        text, whole = None, False
    conf = load(text)
    if not whole:
        save(conf, path)
    return conf


def save(conf: dict, path: str) -> None:
    """Settings to a file: written beside it and moved, so a reader finds the old ones or the new ones."""
    beside = f"{path}.new"
    with open(beside, "w") as f:
        json.dump(conf, f, indent=2, ensure_ascii=False)
    os.replace(beside, path)


def environment(conf: dict) -> dict[str, str]:
    """FOLIOFLOW_<SECTION>_<NAME> as strings; truth values as true and false."""
    return {f"FOLIOFLOW_{s}_{k}".upper(): str(v).lower() if isinstance(v, bool) else str(v) for s, own in conf.items() for k, v in own.items()}


def from_environment(env: dict[str, str]) -> dict:
    out = load(None)
    for s, own in out.items():
        for k, v in own.items():
            text = env.get(f"FOLIOFLOW_{s}_{k}".upper())
            if text is not None:
                own[k] = text.lower() in ("true", "1", "yes") if isinstance(v, bool) else type(v)(text)
    return out


def validate(conf: dict) -> list[str]:
    return [f"{s}.{k} must lie between {low} and {high}" for s, k, _, low, high in SETTINGS if low is not None and not low <= conf[s][k] <= high]


def with_defaults(given: Column, defaults: Column) -> Column:
    """Maps of flat settings: what is given, over the defaults; unknown names go."""
    return F.transform_values(defaults, lambda k, v: F.coalesce(F.element_at(given, k), v))


def flat(spark, conf: dict) -> DataFrame:
    return spark.createDataFrame([(f"{s}.{k}", json.dumps(v)) for s, own in conf.items() for k, v in own.items()], "name string, value string")
