"""Adapters by source id. An adapter is a module-like object with ``parse`` and ``DETECTION``; the rest is optional."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Adapter:
    """``parse`` takes lines (file, line_no, line), or the words of pages where options say so, and returns movements; the other scans return their tables."""

    source: str
    parse: Callable[[DataFrame], DataFrame]
    detection: tuple[tuple[str, ...], ...]
    accounts: Callable[[DataFrame], DataFrame] | None = None
    balances: Callable[[DataFrame], DataFrame] | None = None
    trades: Callable[[DataFrame], DataFrame] | None = None
    name_order: str = "given_first"
    options: dict = field(default_factory=dict)


_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    """Add an adapter; its source id must be new or the same adapter's."""
    if _ADAPTERS.get(adapter.source, adapter) is not adapter:
        raise ValueError(f"source {adapter.source!r} is taken")
    _ADAPTERS[adapter.source] = adapter
    return adapter


def adapters() -> dict[str, Adapter]:
    from . import broker_csv, consolidated_csv, layouts  # noqa: F401  they register themselves

    return dict(_ADAPTERS)


def markers() -> dict[str, tuple[tuple[str, ...], ...]]:
    """Marker groups for detection."""
    return {k: a.detection for k, a in adapters().items()}
