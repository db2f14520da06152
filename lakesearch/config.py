"""Settings with bounds, and overlays of them as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from lakesearch.functions.urls import SKIP_ENDINGS
from lakesearch.operators.search import Weights

# Section, name -> kind, default and bounds (of text: length).
FIELDS: dict[str, dict[str, tuple[type, Any, float, float]]] = {
    "crawler": {
        "max_concurrent": (int, 20, 1, 200),
        "max_depth": (int, 5, 1, 20),
        "max_pages": (int, 50_000, 1, 10_000_000),
        "timeout": (float, 30.0, 1.0, 300.0),
        "politeness_delay": (float, 1.0, 0.0, 60.0),
        "max_retries": (int, 3, 0, 10),
        "max_url_length": (int, 2048, 64, 8192),
        "max_page_size": (int, 5 * 1024 * 1024, 1024, 104_857_600),
        "respect_robots": (bool, True, 0, 1),
        "user_agent": (str, "lakesearch", 0, 200),
    },
    "search": {"page_size": (int, 10, 1, 100), "snippet_chars": (int, 200, 50, 2000)},
    "tokenizer": {"max_word_len": (int, 8, 2, 16), "hmm_enabled": (bool, True, 0, 1)},
    "ranking": {
        "title_weight": (float, 2.5, 0.0, 10.0),
        "description_weight": (float, 1.5, 0.0, 10.0),
        "body_weight": (float, 1.0, 0.0, 10.0),
        "authority_weight": (float, 0.35, 0.0, 10.0),
        "time_decay_days": (float, 0.0, 0.0, 3650.0),
        "k1": (float, 1.5, 0.1, 5.0),
        "b": (float, 0.75, 0.0, 1.5),
    },
    "dedup": {"enabled": (bool, True, 0, 1), "simhash_threshold": (int, 3, 0, 16)},
}


def _checked(section: str, name: str, value: Any) -> Any:
    kind, _, low, high = FIELDS[section][name]
    if kind is bool:
        if not isinstance(value, bool):
            raise ValueError(f"{section}.{name} must be true or false")
        return value
    if isinstance(value, bool):
        raise ValueError(f"{section}.{name} must be {kind.__name__}")
    try:
        value = kind(value)
    except (TypeError, ValueError):
        raise ValueError(f"{section}.{name} must be {kind.__name__}") from None
    size = len(value) if kind is str else value
    if not low <= size <= high:
        raise ValueError(f"{section}.{name} must be within {low:g} and {high:g}")
    return value


@dataclass(frozen=True)
class Settings:
    values: dict[str, dict[str, Any]] = field(default_factory=lambda: {s: {n: f[1] for n, f in fields.items()} for s, fields in FIELDS.items()})
    skip_endings: frozenset[str] = frozenset(SKIP_ENDINGS)

    def with_changes(self, patch: dict[str, dict[str, Any]]) -> Settings:
        """The settings with a patch; ValueError for an unknown section or name or a value out of bounds."""
        values = {s: dict(v) for s, v in self.values.items()}
        for section, changes in patch.items():
            if section not in FIELDS:
                raise ValueError(f"no section {section}")
            for name, value in changes.items():
                if name not in FIELDS[section]:
                    raise ValueError(f"no setting {section}.{name}")
                values[section][name] = _checked(section, name, value)
        return replace(self, values=values)

    def weights(self) -> Weights:
        r = self.values["ranking"]
        return Weights(r["k1"], r["b"], r["title_weight"], r["description_weight"], r["authority_weight"], r["time_decay_days"])

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"skip_endings": sorted(self.skip_endings)}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Stored settings over the defaults; unknown names of other versions are passed over."""
        stored = json.loads(text)
        known = {s: {n: v for n, v in changes.items() if n in FIELDS[s]} for s, changes in stored.get("values", {}).items() if s in FIELDS}
        return replace(cls().with_changes(known), skip_endings=frozenset(stored.get("skip_endings", SKIP_ENDINGS)))
