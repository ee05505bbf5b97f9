"""Settings with defaults, merged with a user's nested values and checked."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

DEFAULTS: dict[str, Any] = {
    "llm": {"model": "local", "timeout": 120, "retries": 3, "min_context": 8192, "max_context": 131072},
    "chunking": {"max_tokens": 1024, "overlap_tokens": 64},
    "deduplication": {"similarity_threshold": 0.92},
    "generation": {"scope": "full", "focus_topic": "", "depth_level": 5, "language": "en"},
    "images": {"min_width": 100, "min_height": 100, "per_chapter": 3},
    "syllabus": {"enabled": True, "path": ""},
}


class ConfigValidationError(ValueError):
    pass


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """`over` laid on `base`, mappings key by key."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


class Config:
    """Values by dotted path."""

    def __init__(self, user: dict[str, Any] | None = None):
        self.values = merged(DEFAULTS, user or {})
        self._check()

    def get(self, path: str, default: Any = None) -> Any:
        node: Any = self.values
        for part in path.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def set(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        node = self.values
        for part in parents:
            node = node.setdefault(part, {})
        node[last] = value
        self._check()

    def _check(self) -> None:
        g = self.values["generation"]
        try:
            g["depth_level"] = max(1, min(10, int(g["depth_level"])))
        except (TypeError, ValueError) as e:
            raise ConfigValidationError("depth_level has to be a number") from e
        if g["scope"] not in ("full", "topic"):
            raise ConfigValidationError("scope is full or topic")
        if g["scope"] == "topic" and not str(g["focus_topic"]).strip():
            raise ConfigValidationError("scope topic needs a focus_topic")
        if self.values["llm"]["timeout"] <= 0 or self.values["llm"]["retries"] < 0:
            raise ConfigValidationError("timeout and retries can't be negative")
        self.values["syllabus"]["enabled"] = str(self.values["syllabus"]["enabled"]).lower() in ("true", "1", "yes", "auto")
