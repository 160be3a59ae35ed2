"""Checking a configuration tree against a schema tree; both are small and stay on the driver.

A schema leaf is a mapping with ``type`` (str, int, float, bool, dict or list[...]) and optionally
``choices``, ``mandatory``, ``default`` and ``depends_on`` (``{path: value or list of values}``).
"""

from __future__ import annotations

import tomllib
from typing import Any

KINDS = {"str": str, "int": int, "float": (int, float), "bool": bool, "dict": dict}


def read_toml(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def parse_toml(text: str) -> dict:
    return tomllib.loads(text)


def recommendation(rows: list[tuple[str, str, float]]) -> str:
    """Settings by section as text that ``parse_toml`` reads: (section, key, value) in the order of sections and keys."""
    out, last = [], None
    for section, key, value in sorted(rows):
        if section != last:
            out += ["", f"[{section}]"] if out else [f"[{section}]"]
            last = section
        out.append(f"{key} = {value!r}")
    return "\n".join(out) + "\n" if out else ""


def at(tree: dict, path: str) -> Any:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return None
        tree = tree[part]
    return tree


def applies(leaf: dict, root: dict) -> bool:
    """Whether all that a leaf depends on holds."""
    for path, want in (leaf.get("depends_on") or {}).items():
        have = at(root, path)
        if (have not in want) if isinstance(want, list) else isinstance(have, dict) and want not in have or not isinstance(have, dict) and have != want:
            return False
    return True


def fits(value: Any, kind: str) -> bool:
    """Whole numbers pass as floats, and true and false as whole numbers."""
    if kind.startswith("list"):
        inner = kind[5:-1] if "[" in kind else ""
        return isinstance(value, list) and (not inner or all(fits(v, inner) for v in value))
    return isinstance(value, KINDS[kind])


def validate(config: dict, schema: dict, root: dict | None = None, path: str = "") -> tuple[list[str], list[str]]:
    """(errors, warnings)."""
    root = config if root is None else root
    errors, warnings = [], []
    for key in config:
        if key not in schema:
            warnings.append(f"{path}{key}: unknown")
    for key, leaf in schema.items():
        where = f"{path}{key}"
        if "type" not in leaf:
            part = config.get(key, {})
            if not isinstance(part, dict):
                errors.append(f"{where}: a section is expected")
                continue
            e, w = validate(part, leaf, root, f"{where}.")
            errors, warnings = errors + e, warnings + w
        elif key not in config:
            if leaf.get("mandatory") and applies(leaf, root):
                errors.append(f"{where}: missing")
        elif leaf.get("deprecated"):
            warnings.append(f"{where}: deprecated")
        elif not fits(config[key], leaf["type"]):
            errors.append(f"{where}: {leaf['type']} is expected")
        elif "choices" in leaf and config[key] not in leaf["choices"]:
            errors.append(f"{where}: one of {leaf['choices']} is expected")
    return errors, warnings


def with_defaults(config: dict, schema: dict) -> dict:
    """The configuration with defaults filled in, text turned into the leaf's type."""
    out = dict(config)
    for key, leaf in schema.items():
        if "type" not in leaf:
            out[key] = with_defaults(config.get(key, {}), leaf)
        elif key not in out and "default" in leaf:
            out[key] = leaf["default"]
        elif isinstance(out.get(key), str) and leaf["type"] in ("int", "float"):
            out[key] = (int if leaf["type"] == "int" else float)(out[key])
        elif isinstance(out.get(key), str) and leaf["type"] == "bool":
            out[key] = out[key].strip().lower() in ("true", "yes", "1")
    return out
