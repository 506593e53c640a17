"""A resource: one table backed by several ordered layers, with what may be asked of it."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql.types import StructType

from strata.functions.normal import normalise
from strata.functions.predicate import Predicate
from strata.operators.aggregates import KINDS, Aggregate, Relationship
from strata.operators.query import Calculation
from strata.sources.layers import EXPRESSIONS, READ, SELECT, TENANTS, TRANSACT, UPSERT, Layer, SnapshotLayer

PROVEN, OUTBOX = "proven", "outbox"


class ConfigError(ValueError):
    """A resource that contradicts itself."""


class Unsupported(NotImplementedError):
    """A feature that is refused because its rows would escape the proof."""


@dataclass(frozen=True)
class OutboxOptions:
    """stale_field: the attribute whose change at the target, seen from the base image, is a conflict (None: last writer wins)."""

    targets: tuple[str, ...] = ()
    stale_field: str | None = None
    hydrate: str = "manual"  # manual, on_start, if_empty
    mode: str = "async"  # async, write_through
    max_attempts: int = 10
    keep_days: int = 7
    #: A folder that outlives the process: local rows and entries are committed there together, and opened again from it.
    store: str | None = None
    sweep_seconds: float | None = None
    on_enqueue: Callable | None = None  # called with the outbox after each write
    remote_context: Mapping | Callable | None = None  # for targets with configure(): a mapping, or a function of their name


@dataclass(frozen=True)
class Resource:
    name: str
    schema: StructType
    primary_key: tuple[str, ...]
    layers: Mapping[str, Layer]
    read_order: tuple[str, ...]
    write_order: tuple[str, ...] = ()
    strategy: object = PROVEN  # PROVEN, OUTBOX, or a Strategy of one's own: the class, or (class, options)
    relationships: Mapping[str, Relationship] = field(default_factory=dict)
    calculations: Mapping[str, Calculation] = field(default_factory=dict)
    aggregates: Mapping[str, Aggregate] = field(default_factory=dict)
    tenant_attribute: str | None = None
    tenant_global: bool = False
    ledger_cap: int = 10_000
    divergence: float = 0.0
    local_evaluation: bool = True
    fold_aggregates: bool = True
    join_aggregates: bool = True
    overrides: frozenset[str] = frozenset()  # calculations and aggregates that only the source answers
    base_filter: Predicate | None = None
    column_masks: tuple[str, ...] = ()
    single_driver: bool = True
    outbox: OutboxOptions = OutboxOptions()

    @cached_property
    def names(self) -> list[str]:
        return list(self.schema.names)

    @cached_property
    def types(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.schema.fields}

    @property
    def source(self) -> Layer:
        """The read authority: the last layer asked."""
        return self.layers[self.read_order[-1]]

    @property
    def cache(self) -> Layer | None:
        return self.layers[self.read_order[0]] if len(self.read_order) > 1 else None

    @property
    def authority(self) -> Layer | None:
        """The write authority: the first layer written."""
        return self.layers[self.write_order[0]] if self.write_order else None

    def layer(self, name: str) -> Layer:
        if name not in self.layers:
            raise ConfigError(f"{self.name}: no layer {name!r}")
        return self.layers[name]

    def validate(self) -> Resource:
        def need(ok: bool, text: str) -> None:
            if not ok:
                raise ConfigError(f"{self.name}: {text}")

        need(bool(self.read_order), "read_order is empty")
        for name in (*self.read_order, *self.write_order):
            need(name in self.layers, f"layer {name!r} is not declared")
        need(all(n == x.name for n, x in self.layers.items()), "a layer is filed under another name")
        for order in (self.read_order, self.write_order):
            need(len(set(order)) == len(order), "a layer stands twice in an order")
        need(set(self.primary_key) <= set(self.names) and bool(self.primary_key), "the primary key is not in the schema")
        for name in self.read_order[:-1]:
            need(UPSERT in self.layers[name].capabilities, f"cache layer {name!r} can't be written")
        for name in self.write_order:
            need(UPSERT in self.layers[name].capabilities, f"layer {name!r} can't be written")
        from strata.plans.strategy import chosen

        chosen(self)
        if self.strategy == PROVEN:
            need(not self.write_order or self.read_order[-1] == self.write_order[0], "the last layer read has to be the first one written")
        elif self.strategy == OUTBOX:
            need(len(self.read_order) == 1, "an outbox resource reads one layer")
            need(bool(self.write_order) and self.write_order[0] == self.read_order[0], "an outbox resource reads what it writes first")
            need(bool(self.outbox.targets), "an outbox resource needs a target")
            need(all(t in self.layers for t in self.outbox.targets), "a target is not declared")
            need(self.outbox.hydrate in ("manual", "on_start", "if_empty"), "no such hydrate mode")
            need(self.outbox.mode in ("async", "write_through"), "no such write mode")
            need(isinstance(self.authority, SnapshotLayer), "entries can only be committed together with rows of a snapshot layer")
            need(not any(self.layers[t] is self.authority for t in self.outbox.targets), "the local layer is no target")
            need(self.outbox.stale_field is None or self.outbox.stale_field in self.names, "the stale field is not in the schema")
        if self.tenant_attribute:
            need(self.tenant_attribute in self.names, "the tenant attribute is not in the schema")
            need(all(TENANTS in x.capabilities for x in self.layers.values()), "a layer can't keep tenants apart")
        known = {*self.calculations, *self.aggregates}
        need(self.overrides <= known, f"overrides that are no calculation or aggregate: {sorted(self.overrides - known)}")
        for a in self.aggregates.values():
            need(a.relationship in self.relationships, f"aggregate {a.name!r} has no relationship")
            need(a.kind in KINDS, f"aggregate {a.name!r}: no kind {a.kind!r}")
        need(not self.column_masks or len(self.read_order) == 1, "masked columns can't be cached for everyone")
        if not self.single_driver:
            warnings.warn(f"{self.name}: the ledger lives in one driver; others don't see its invalidations", stacklevel=2)
        if self.base_filter is not None and normalise(self.base_filter, self.types).opaque:
            warnings.warn(f"{self.name}: nothing can be proven about the base filter, so no read will hit", stacklevel=2)
        return self

    def can(self, feature: str | tuple[str, str]) -> bool:
        """Is a feature offered? Reads by all read layers, writes by all write layers; some only by an authority."""
        if isinstance(feature, tuple) and feature[0] == "aggregate":
            return feature[1] in KINDS and (self.fold_aggregates or self.join_aggregates)
        if feature in ("join", "lateral_join", "combine", "bulk", "update_query", "destroy_query", "atomic", "aggregate_filter", "aggregate_sort", "async_engine"):
            return self.strategy == OUTBOX and feature in ("join", "lateral_join")
        if feature in ("select", "lock"):
            return SELECT in self.source.capabilities
        if feature == "transact":
            return self.authority is not None and TRANSACT in self.authority.capabilities and hasattr(self.authority, "restore")
        if feature == "multitenancy":
            return all(TENANTS in x.capabilities for x in self.layers.values())
        if feature in ("create", "update", "destroy", "upsert"):
            return bool(self.write_order) and all(UPSERT in self.layers[n].capabilities for n in self.write_order)
        if feature == "expression_calculation":
            return all(EXPRESSIONS in self.layers[n].capabilities for n in self.read_order)
        return feature in ("read", "filter", "boolean_filter", "sort", "limit", "offset", "distinct", "distinct_sort") and all(
            READ in self.layers[n].capabilities for n in self.read_order
        )
