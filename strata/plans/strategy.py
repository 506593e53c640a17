"""The seam between the engine and the ways in which a resource is read and written."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from strata.plans.resource import OUTBOX, PROVEN, ConfigError, Resource


class Strategy(ABC):
    """What a resource does with reads, writes and news of other systems. One instance serves one resource of one engine.

    A strategy of one's own subclasses this and is named by ``Resource.strategy``, as the class or as (class, options).
    """

    def __init__(self, engine, resource: Resource, **options):
        self.engine, self.r, self.options = engine, resource, options

    @classmethod
    def validate(cls, resource: Resource, **options) -> None:
        """Raise a ConfigError for options that contradict the resource. None are known here."""
        if options:
            raise ConfigError(f"{resource.name}: {cls.__name__} has no option {sorted(options)}")

    def start(self) -> None:
        """What is to happen when the process starts."""

    def stop(self) -> None:
        """What is to happen before it ends."""

    @abstractmethod
    def read(self, q) -> DataFrame: ...

    @abstractmethod
    def aggregate(self, q, columns: dict) -> DataFrame: ...

    @abstractmethod
    def write(self, op: str, rows: DataFrame, tenant: str | None, condition: str | None) -> DataFrame: ...

    @abstractmethod
    def can(self, feature) -> bool: ...

    @abstractmethod
    def on_external_change(self, keys: DataFrame, tenant: str | None): ...

    @abstractmethod
    def on_external_gap(self, tenant: str | None): ...


class Proven(Strategy):
    """Reads from the first layer that is proven to hold the answer; writes the authority, then the others."""

    def read(self, q):
        return self.engine.read_proven(q, self.r)

    def aggregate(self, q, columns):
        return self.engine.whole(q, self.r, self.r.source, columns)

    def write(self, op, rows, tenant, condition):
        return self.engine.write_proven(self.r, op, rows, tenant, condition)

    def can(self, feature):
        return self.r.can(feature)

    def on_external_change(self, keys, tenant):
        return self.engine.forget(self.r.name, keys, tenant)

    def on_external_gap(self, tenant):
        return self.engine.drop_all(self.r.name, tenant)


class LocalFirst(Strategy):
    """Reads and writes the local layer; an outbox carries the writes to the targets."""

    def __init__(self, engine, resource, **options):
        from strata.plans.outbox import Outbox

        super().__init__(engine, resource, **options)
        self.box = engine.outboxes[resource.name] = Outbox(engine, resource)

    def start(self):
        self.box.boot()

    def stop(self):
        self.box.stop()

    def read(self, q):
        return self.engine.read_layer(q, self.r, self.r.authority)

    def aggregate(self, q, columns):
        return self.engine.whole(q, self.r, self.r.authority, columns)

    def write(self, op, rows, tenant, condition):
        return self.box.write(op, rows, tenant, condition)

    def can(self, feature):
        return self.r.can(feature)

    def on_external_change(self, keys, tenant):
        return self.box.refresh(keys, tenant)

    def on_external_gap(self, tenant):
        return self.box.refresh(None, tenant)


BUILT_IN = {PROVEN: Proven, OUTBOX: LocalFirst}


def chosen(resource: Resource) -> tuple[type[Strategy], dict]:
    """The class and options that a resource names; one that lacks a callback is refused."""
    named = resource.strategy
    kind, options = named if isinstance(named, tuple) else (named, {})
    kind = BUILT_IN.get(kind, kind) if isinstance(kind, str) else kind
    if not (isinstance(kind, type) and issubclass(kind, Strategy)):
        raise ConfigError(f"{resource.name}: no strategy {kind!r}")
    if missing := sorted(getattr(kind, "__abstractmethods__", ())):
        raise ConfigError(f"{resource.name}: {kind.__name__} lacks {', '.join(missing)}")
    kind.validate(resource, **options)
    return kind, dict(options)
