"""Vocabulary files: categories with labels and rules, merchant codes with ranges, banks by code, settings."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from . import vocabulary as V


@dataclass(frozen=True)
class Vocabulary:
    """What the files say; what they don't say is that of :mod:`vocabulary`."""

    labels: dict[str, dict[str, str]] = field(default_factory=lambda: dict(V.LABELS))
    rules: tuple[tuple[str, str], ...] = V.RULES
    assets: tuple[str, ...] = V.ASSETS
    default: str = V.DEFAULT
    mcc: dict[str, str] = field(default_factory=lambda: dict(V.MCC))
    banks: dict[str, str] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def setting(self, path: str, default=None):
        return V.setting(self.settings, path, default)

    def bank_table(self, spark):
        """(abi, bank_name), a table of a row per bank."""
        return spark.createDataFrame(sorted(self.banks.items()), "abi string, bank_name string")


def read(folder: str, name: str) -> dict:
    """A JSON file, or a YAML one where a YAML reader is installed; {} if neither is there."""
    for suffix in ("json", "yaml", "yml"):
        path = os.path.join(folder, f"{name}.{suffix}")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                if suffix == "json":
                    return json.load(f)
                import yaml

                return yaml.safe_load(f) or {}
    return {}


def codes(table: dict) -> dict[str, str]:
    """Codes of four digits and "lo-hi" ranges; ValueError for anything else."""
    out = {}
    for k, v in table.items():
        key = str(k).zfill(4) if re.fullmatch(r"\d{1,4}", str(k)) else str(k)
        low, _, high = key.partition("-")
        if not re.fullmatch(r"\d{4}(?:-\d{4})?", key) or (high and low > high):
            raise ValueError(f"merchant code {k!r}")
        out[key] = str(v)
    return out


def load(folder: str) -> Vocabulary:
    """categories, mcc, banks and settings of a folder. Categories that rules or codes name must be among the labels."""
    said, mcc, banks, settings = (read(folder, n) for n in ("categories", "mcc", "banks", "settings"))
    labels = said.get("categories") or V.LABELS
    rules = tuple((r["pattern"], r["category"]) if isinstance(r, dict) else tuple(r) for r in said.get("rules") or V.RULES)
    out = Vocabulary(
        labels=labels, rules=rules, assets=tuple(said.get("assets", [a for a in V.ASSETS if a in labels])), default=said.get("default") or V.DEFAULT, mcc=codes(mcc.get("mcc", mcc)) or dict(V.MCC),
        banks={str(k).zfill(5): v for k, v in (banks.get("abi") or banks).items()}, settings=settings,
    )
    unknown = ({c for _, c in out.rules} | set(out.mcc.values()) | set(out.assets)) - set(labels) - {out.default}
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    for pattern, _ in out.rules:
        re.compile(pattern)
    return out
