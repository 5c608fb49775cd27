"""Settings that change results, and where they come from."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults of a run. ``as_of`` is the day that dates are held against; no clock is read."""

    as_of: str = "2026-01-01"
    recursive: bool = True
    min_text_chars: int = 20
    text_quality_min: float = 0.55
    ocr_enabled: str = "auto"
    cmap_probe_max_kb: int = 512
    pdf_stream_max_mb: int = 16
    min_confidence: float = 0.75
    min_critical_confidence: float = 0.50
    balance_tolerance: float = 0.02
    rate_rel_tolerance: float = 0.02
    rate_abs_floor: float = 0.05
    vendor_similarity: float = 0.90
    future_date_grace_days: int = 0
    missing_amount_warning: bool = False
    on_duplicate: str = "skip"
    force: bool = False
    retry_failed: bool = False
    fallback_enabled: bool = False
    fallback_max_chars: int = 6000
    rules_disabled: frozenset[str] = field(default_factory=frozenset)


def _coerced(old, new):
    if isinstance(old, bool):
        return str(new).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(old, frozenset):
        return frozenset(new if isinstance(new, (list, tuple, set, frozenset)) else filter(None, (x.strip() for x in str(new).split(","))))
    return type(old)(new)


def load_config(path: str | None = None, env: dict[str, str] | None = None, rows: list[tuple[str, object]] = ()) -> Config:
    """Defaults, then rows of a settings sheet (name, value), then a JSON file, then INVOICE_* variables.

    Each value is coerced to the default's type; a value that does not fit and a name that
    is not known are left out.
    """
    given = {str(k): v for k, v in rows}
    if path:
        with open(path, encoding="utf-8") as f:
            given.update(json.load(f))
    given.update({k[8:].lower(): v for k, v in (os.environ if env is None else env).items() if k.startswith("INVOICE_")})
    cfg = Config()
    for f in fields(Config):
        if f.name in given and given[f.name] is not None:
            try:
                cfg = replace(cfg, **{f.name: _coerced(getattr(cfg, f.name), given[f.name])})
            except (TypeError, ValueError):
                continue
    return cfg
