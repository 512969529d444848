"""The column-role contract shared by all sequence operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in a panel table.

    ``tie`` must make ``(series, ts, tie)`` unique (an id column does); every
    order-dependent operator sorts by ``(ts, *tie)``, so results never depend
    on file order.
    """

    entity: str
    series: tuple[str, ...]
    ts: str
    tie: tuple[str, ...]
    value: str

    @property
    def keys(self) -> list[str]:
        return list(self.series)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]
