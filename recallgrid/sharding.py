"""A consistent-hash ring, for clients that place tenants on stores. Spark itself needs none of it."""

from __future__ import annotations

from bisect import bisect_left

from .functions.scalars import fnv1a64


class Ring:
    """Shards at several points each on a ring of 64-bit hashes; a key belongs to the first point at or after it."""

    def __init__(self, shards: int, points: int = 64):
        self.at = sorted((fnv1a64(f"shard-{s}-vnode-{v}".encode()), s) for s in range(shards) for v in range(points))
        self.hashes = [h for h, _ in self.at]

    def owner(self, key: str) -> int | None:
        if not self.at:
            return None
        return self.at[bisect_left(self.hashes, fnv1a64(key.encode())) % len(self.at)][1]


def moves(old: Ring, new: Ring, keys: list[str]) -> dict[str, tuple[int | None, int | None]]:
    """Keys whose owner changes, with the owner before and after."""
    pairs = {k: (old.owner(k), new.owner(k)) for k in keys}
    return {k: v for k, v in pairs.items() if v[0] != v[1]}


def scale_steps(now: int, wanted: int) -> list[int]:
    """Shard counts on the way from one size to another, one shard at a time."""
    return list(range(now + 1, wanted + 1)) if wanted >= now else list(range(now - 1, wanted - 1, -1))
