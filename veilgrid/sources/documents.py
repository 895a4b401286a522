"""Configuration documents: taxonomies, rules, policies and manifests in JSON or YAML."""

from __future__ import annotations

import json

try:
    import yaml
except ImportError:  # JSON documents need no reader of their own
    yaml = None


def records(text: str, key: str) -> list:
    """The list that a document holds under ``key``, or that it is; an empty document is an empty list."""
    try:
        held = json.loads(text) if text.strip() else []
    except json.JSONDecodeError as bad:
        if yaml is None:
            raise ValueError("not a JSON document, and no reader for YAML is installed") from bad
        held = yaml.safe_load(text) or []
    held = held.get(key) or [] if isinstance(held, dict) else held
    if not isinstance(held, list):
        raise ValueError(f"no list of {key}")
    return held
