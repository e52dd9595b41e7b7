"""Small files read by the driver: rule sets, policies, baselines, known names, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from heddle.operators.rules import RULES, SEVERITY_RANK, Rule


def _read(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:  # pragma: no cover - depends on the installation
            raise ValueError(f"{path}: reading YAML needs the yaml package") from e
        return yaml.safe_load(text)
    return json.loads(text)


#: Names of the checks in rule files, and what they are called here.
CHECKS = {"typosquat": "typosquat", "npm_provenance": "provenance", "npm_install_script": "install_script", "registry_age": "registry_age"}


def load_rules(directory: str | None = None) -> tuple[Rule, ...]:
    """The built-in rules, or those of a directory's JSON or YAML files in name order.

    A file is one rule: id, title, owasp, severity, confidence, recommendation, network, and
    detect with target, pattern, allow_if, type, also, and for some types reference_list (a
    file of names in the folder ``data``), max_distance or max_age_days. A type that is
    unknown is none. Files that are no mapping with an id are skipped.
    """
    if directory is None:
        return RULES
    out = []
    for p in sorted(Path(directory).iterdir()):
        if p.suffix not in (".json", ".yaml", ".yml"):
            continue
        r = _read(p)
        if isinstance(r, dict) and r.get("id"):
            d = r.get("detect") or {}
            names = Path(directory) / "data" / str(d.get("reference_list") or "")
            out.append(
                Rule(
                    r["id"], r.get("title", r["id"]), r.get("owasp", ""), r.get("severity", "medium"), r.get("confidence", "medium"),
                        d.get("target", "command"),
                    (d.get("pattern") or "").replace("(?P<", "(?<"), d.get("allow_if") or "", CHECKS.get(d.get("type"), ""),
                    d.get("also") or "", bool(r.get("network")), r.get("phase", "static"),
                    recommendation=r.get("recommendation", ""), max_distance=int(d.get("max_distance", 2)),
                        max_age_days=int(d.get("max_age_days", 30)),
                    known=tuple(load_names(str(names))) if names.is_file() else (),
                )
            )
    return tuple(out)


@dataclass
class Allowed:
    name: str
    version: str | None = None
    digest: str | None = None

    def __post_init__(self):
        if self.version is not None and self.digest is not None:
            raise ValueError(f"{self.name}: version and digest exclude each other")


@dataclass
class Policy:
    mode: str = "enforce"
    fail_on: str = "high"
    blocked_registries: list[str] = field(default_factory=list)
    servers: list[Allowed] = field(default_factory=list)


def load_policy(path: str) -> Policy:
    """A policy of mode, fail_on, blocked_registries and a list of servers; else ValueError."""
    data = _read(Path(path)) or {}
    if not isinstance(data, dict) or set(data) - {f.name for f in fields(Policy)}:
        raise ValueError(f"{path} is no policy")
    servers = data.get("servers", [])
    if not isinstance(servers, list) or data.get("fail_on", "high") not in SEVERITY_RANK:
        raise ValueError(f"{path} is no policy")
    try:
        return Policy(**{**data, "servers": [Allowed(**s) for s in servers]})
    except TypeError as e:
        raise ValueError(f"{path} is no policy: {e}") from e


def load_baseline(path: str) -> list[str]:
    p = Path(path)
    return sorted(set(json.loads(p.read_text()))) if p.is_file() else []


def write_baseline(fingerprints: list[str], path: str) -> None:
    Path(path).write_text(json.dumps(sorted(set(fingerprints)), indent=2) + "\n")


def load_names(path: str) -> list[str]:
    """A list of names in order; the order breaks ties of equal distance."""
    return [str(x) for x in _read(Path(path))]


@dataclass
class PollSettings:
    base_url: str = "https://registry.example"
    page_limit: int = 100

    @classmethod
    def load(cls, path: str | None) -> PollSettings:
        data = _read(Path(path)) if path and Path(path).is_file() else {}
        return cls(**{k: v for k, v in (data or {}).items() if k in {f.name for f in fields(cls)}})


def rule_pages(rules: tuple[Rule, ...] = RULES) -> dict[str, str]:
    """Markdown page per rule id."""
    out = {}
    for r in rules:
        how = f"check `{r.check}`" if r.check else f"pattern over `{r.target}`"
        out[r.id] = f"# {r.id}\n\n{r.title}\n\n| severity | confidence | class | detection |\n|---|---|---|---|\n| {r.severity} | {r.confidence} | {r.owasp} | {how} |\n\n{r.recommendation}\n"
    return out
