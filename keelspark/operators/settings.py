"""Settings of a store as plain values, what they mean for eviction and encoding, and the number coercions of replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How records are laid out: fields per shard, the largest value that stays compact, shared field names."""

    shard_width: int = 124
    max_value_bytes: int = 512
    templates: bool = False

    def settings(self) -> dict[str, str]:
        """The settings that keep shards of this width compact: room for twice the width."""
        wide = max(128, 2 * self.shard_width)
        return {"hash-max-listpack-entries": str(max(512, wide)), "hash-max-listpack-value": str(self.max_value_bytes), "hash-min-template-entries": "4" if self.templates else "0"}


@dataclass(frozen=True)
class SafeEviction:
    """Only entries with a time to live are candidates, the soonest to expire first."""

    maxmemory: int | None = None
    policy: str = "volatile-ttl"

    def settings(self) -> dict[str, str]:
        return {"maxmemory-policy": self.policy} | ({} if self.maxmemory is None else {"maxmemory": str(self.maxmemory)})


def is_candidate(ttl: Column, policy: str = "volatile-ttl") -> Column:
    return F.lit(True) if policy.startswith("allkeys") else F.lit(False) if policy == "noeviction" else ttl.isNotNull()


def number(text: Column) -> Column:
    """A reply as a number; what is none, or not finite, is 0."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def is_error(reply: Column) -> Column:
    """Replies that begin with a minus carry an error."""
    return F.coalesce(reply.startswith("-"), F.lit(False))
