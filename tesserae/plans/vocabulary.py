"""The vocabulary of routing, read from files: a shared one, and a local one beside it that adds or replaces domains."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from tesserae.plans.routing import DOMAINS, Domain


@dataclass(frozen=True)
class Vocabulary:
    """Domains in order, and the thresholds of a route's confidence."""

    domains: tuple[Domain, ...]
    confident: float = 0.62
    gap: float = 0.12
    clash: float = 0.4


def read_settings(path: str | Path) -> dict:
    """A settings file, YAML or JSON by its suffix; empty if there is none."""
    p = Path(path)
    if not p.is_file():
        return {}
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() == ".json":
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{p.name}: a YAML reader is not installed; use JSON") from e
    return yaml.safe_load(text) or {}


def load_vocabulary(path: str | Path) -> Vocabulary:
    """The vocabulary of a file and of its local companion (name.local.suffix), whose domains replace those of
    the same id and follow the others; its thresholds win. Without a file the built-in domains are used."""
    p = Path(path)
    shared, local = read_settings(p), read_settings(p.with_name(f"{p.stem}.local{p.suffix}"))
    rows: dict[str, dict] = {}
    for d in [*(shared.get("domains") or []), *(local.get("domains") or [])]:
        rows[str(d.get("id") or d.get("label"))] = d
    limits = (shared.get("confidence") or {}) | (local.get("confidence") or {})
    domains = tuple(
        Domain(
            name, d.get("dataset") or "", tuple(map(str, d.get("terms") or ())), tuple(map(str, d.get("patterns") or ())), d.get("folder_filter") or None,
            bool(d.get("authoritative", False)), tuple(map(str, d.get("expansions") or ())),
        )
        for name, d in rows.items()
    )
    return Vocabulary(domains or DOMAINS, float(limits.get("confident", 0.62)), float(limits.get("ambiguous_gap", 0.12)), float(limits.get("cross_dataset_ratio", 0.4)))


#: Labels of structured values by the words of a question.
LABEL_WORDS = {"параметр настройки": "Параметр настройки", "потеря давления": "Потеря давления", "падение давления": "Падение давления"}


def label_hint(question: str) -> str | None:
    """The label of structured values a question asks for, if it names one."""
    q = " ".join(question.lower().replace("ё", "е").split())
    return next((label for words, label in LABEL_WORDS.items() if words in q), None)
