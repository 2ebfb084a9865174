"""Settings as strict nested mappings: unknown, duplicate or out-of-range ones are refused with their place."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass


class ConfigError(ValueError):
    pass


def setting(default, least=None, most=None, choices=None):
    return field(default=default, metadata={"least": least, "most": most, "choices": choices})


@dataclass(frozen=True)
class Storage:
    partitions: int = setting(4, 1, 128)
    max_segment_bytes: int = setting(4096, 1)
    max_segment_age_seconds: int = setting(0, 0)


@dataclass(frozen=True)
class Retention:
    max_bytes: int = setting(0, 0)
    max_age_seconds: int = setting(0, 0)


@dataclass(frozen=True)
class Limits:
    max_fetch_records: int = setting(100, 1)
    max_fetch_bytes: int = setting(0, 0)
    max_response_bytes: int = setting(0, 0)
    max_batch_records: int = setting(1 << 20, 1)
    max_batch_bytes: int = setting(64 << 20, 1)


@dataclass(frozen=True)
class Metrics:
    enabled: bool = setting(True)
    unstable_percent: float = setting(15.0, 0)


@dataclass(frozen=True)
class Logging:
    level: str = setting("warn", choices=("debug", "info", "warn", "error"))


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    retention: Retention = field(default_factory=Retention)
    limits: Limits = field(default_factory=Limits)
    metrics: Metrics = field(default_factory=Metrics)
    logging: Logging = field(default_factory=Logging)


_SECTIONS = {"storage": Storage, "retention": Retention, "limits": Limits, "metrics": Metrics, "logging": Logging}


def _value(raw, kind, meta: dict, place: str):
    if kind is float and isinstance(raw, int) and not isinstance(raw, bool):
        raw = float(raw)
    if type(raw) is not kind:
        raise ConfigError(f"{place} must be of type {kind.__name__}")
    least, most, choices = meta.get("least"), meta.get("most"), meta.get("choices")
    if (least is not None and raw < least) or (most is not None and raw > most) or (choices and raw not in choices):
        raise ConfigError(f"{place} is out of range: {raw!r}")
    return raw


def _build(kind, raw, place: str):
    if not isinstance(raw, dict):
        raise ConfigError(f"{place} must be a mapping")
    known = {f.name: f for f in fields(kind)}
    for name in raw:
        if name not in known:
            raise ConfigError(f"unknown setting {place}.{name}")
    made = {}
    for name, value in raw.items():
        part = _SECTIONS.get(name) if kind is Config else None
        made[name] = _build(part, value, f"{place}.{name}") if part and is_dataclass(part) else _value(value, type(known[name].default), known[name].metadata, f"{place}.{name}")
    return kind(**made)


def from_mapping(raw: dict) -> Config:
    config = _build(Config, raw, "config")
    if config.limits.max_response_bytes and config.limits.max_fetch_bytes > config.limits.max_response_bytes:
        raise ConfigError("config.limits.max_fetch_bytes exceeds config.limits.max_response_bytes")
    return config


def _once(pairs: list) -> dict:
    found: dict = {}
    for name, value in pairs:
        if name in found:
            raise ConfigError(f"duplicate setting {name}")
        found[name] = value
    return found


def from_text(text: str) -> Config:
    """A configuration from JSON."""
    try:
        raw = json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError as wrong:
        raise ConfigError(f"line {wrong.lineno}, column {wrong.colno}: {wrong.msg}") from wrong
    return from_mapping(raw)
