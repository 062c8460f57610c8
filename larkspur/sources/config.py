"""Settings from a YAML file, with a small parser where no YAML library is installed."""

from __future__ import annotations

import os

from larkspur.schema import Settings


def parse_simple(text: str) -> dict:
    """`key: value` lines and one level of nesting; booleans, numbers, quoted and plain strings."""
    out: dict = {}
    section: dict | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        name, value = bare.strip().split(":", 1)
        target = section if line[:1].isspace() and section is not None else out
        if value.strip():
            target[name] = scalar(value.strip())
        else:
            section = out.setdefault(name, {})
        if not line[:1].isspace() and value.strip():
            section = None
    return out


def scalar(value: str):
    if value[:1] in "\"'" and value[-1:] == value[:1]:
        return value[1:-1]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if value.lower() in ("null", "none", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def load(path: str) -> dict:
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return parse_simple(text)
    return yaml.safe_load(text) or {}


def settings(path: str | None = None, environment: dict | None = None) -> Settings:
    """Environment over file over default; values out of range are clamped."""
    found = load(path) if path else {}
    found = found.get("runtime", found)
    names = Settings.__dataclass_fields__
    values = {k: v for k, v in found.items() if k in names}
    for k in names:
        if (v := (environment or {}).get(k.upper())) is not None:
            values[k] = scalar(v)
    return Settings().with_(**values)
