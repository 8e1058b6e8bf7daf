"""Configuration: YAML or JSON, environment overrides with the prefix PII_, migration of version 1."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from piispan.functions.detector import Options
from piispan.operators.act import Rule

VERSION = 2
#: Risk thresholds of version 1's named levels.
LEVELS = {"low": 25, "medium": 50, "high": 75, "critical": 90}


@dataclass(frozen=True)
class Settings:
    version: int = VERSION
    strategy: str = "mask"
    confidence_threshold: float = 0.0
    min_votes: int = 1
    detectors: tuple[str, ...] = ("regex",)
    max_merge: bool = True
    rules: tuple[Rule, ...] = field(default_factory=lambda: (Rule("BLOCK", ("API_KEY",)), Rule("BLOCK", risk=80.0)))
    alias_ttl_hours: int = 24
    last_user_only: bool = False

    def options(self) -> Options:
        return Options(min_score=self.confidence_threshold)


def migrated(raw: dict[str, Any]) -> dict[str, Any]:
    """Version 1 (a named risk level, flat keys) as version 2."""
    if raw.get("version", 1) >= VERSION:
        return raw
    out = {k: v for k, v in raw.items() if k not in ("risk_level", "mode")}
    out["version"] = VERSION
    if "mode" in raw:
        out["strategy"] = raw["mode"]
    if "risk_level" in raw:
        out["rules"] = [*raw.get("rules", []), {"action": "REVIEW", "risk": LEVELS[str(raw["risk_level"]).lower()], "operator": ">"}]
    return out


def from_dict(raw: dict[str, Any]) -> Settings:
    raw = migrated(dict(raw))
    known = {k: v for k, v in raw.items() if k in Settings.__dataclass_fields__}
    if "rules" in known:
        known["rules"] = tuple(r if isinstance(r, Rule) else Rule(r["action"], tuple([r["types"]] if isinstance(r.get("types"), str) else r.get("types") or ()), r.get("risk"), r.get("operator", ">=")) for r in known["rules"])
    if "detectors" in known:
        known["detectors"] = tuple(known["detectors"])
    for name, kind in (("strategy", str), ("confidence_threshold", float), ("min_votes", int), ("alias_ttl_hours", int)):
        if (value := os.environ.get("PII_" + name.upper())) is not None:
            known[name] = kind(value)
    return Settings(**known)


def load(path: str | Path) -> Settings:
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text) or {})


def dump(settings: Settings, path: str | Path) -> None:
    plain = json.loads(json.dumps(asdict(settings)))
    if str(path).endswith(".json"):
        Path(path).write_text(json.dumps(plain, indent=2))
    else:
        import yaml

        Path(path).write_text(yaml.safe_dump(plain, sort_keys=False))
