"""Links between 64-bit fingerprints that differ in few bits, through vantage-point trees.

A vantage point splits fingerprints by their Hamming distance to it. A tree fitted on a bounded
sample deals all fingerprints into shards; where the triangle bounds allow a partner beyond a
split, the fingerprint also visits the shards there. Inside a shard a second tree prunes the same
way, and what is left is compared exactly. A shard reports a spanning star of each of its local
components, so a dense group gives no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timbre.llm.components import smallest_labels

#: Fingerprints that call one shard their home, about: ever more as there are more of them, for the visits
#: beyond a shard's boundary grow with the number of shards, but no more than a task holds easily.
SHARD_SIZE, MOST_SHARD_SIZE, SHARDS = 16_384, 1 << 20, 64
#: Most fingerprints that the dealing tree is fitted on, and how many for each shard.
SAMPLE_LIMIT, SAMPLE_PER_SHARD = 262_144, 64
_LEAF = 256
_PAIRS_AT_ONCE = 1 << 20
_VANTAGE_TRIALS = 12


@dataclass
class Node:
    """Inner node: ``near`` holds distances up to ``radius``, ``far`` the rest. Leaf: ``members``."""

    vantage: np.uint64 = np.uint64(0)
    radius: int = 0
    near: Node | None = None
    far: Node | None = None
    members: np.ndarray | None = None
    number: int = -1


def distances(prints: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ one).astype(np.int64)


def build(prints: np.ndarray, members: np.ndarray, leaf: int) -> Node:
    """Tree over ``prints[members]``; the vantage point is the trial with the widest distances."""
    if len(members) <= leaf:
        return Node(members=members)
    own = prints[members]
    step = max(1, len(own) // _VANTAGE_TRIALS)
    look = own[:: max(1, len(own) // 512)]
    vantage = max(own[::step][:_VANTAGE_TRIALS], key=lambda v: float(distances(look, v).std()))
    away = distances(own, vantage)
    radius = int(np.median(away))
    if radius >= away.max():
        radius = int(away.max()) - 1
    near = away <= radius
    if radius < 0 or not near.any():
        return Node(members=members)
    return Node(vantage, radius, build(prints, members[near], leaf), build(prints, members[~near], leaf))


def leaves(tree: Node) -> list[Node]:
    found, open_nodes = [], [tree]
    while open_nodes:
        node = open_nodes.pop()
        if node.members is None:
            open_nodes += [node.far, node.near]
        else:
            found.append(node)
    return found


def route(tree: Node, prints: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, positions in ``prints``, home?) so that every close pair meets where one is at home."""
    everyone = np.arange(len(prints))
    work = [(tree, everyone, everyone[:0])]
    while work:
        node, homes, guests = work.pop()
        if not len(homes) and not len(guests):
            continue
        if node.members is not None:
            for who, home in ((homes, True), (guests, False)):
                if len(who):
                    yield node.number, who, home
            continue
        home_at, guest_at = distances(prints[homes], node.vantage), distances(prints[guests], node.vantage)
        near = home_at <= node.radius
        # a pair across the split is met on its far side
        crossing = homes[near & (home_at > node.radius - reach)]
        work.append((node.near, homes[near], guests[guest_at - reach <= node.radius]))
        work.append((node.far, homes[~near], np.concatenate([crossing, guests[guest_at + reach > node.radius]])))


class _Union:
    """Smallest-label components of positions, fed with arrays of pairs."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self._held.append((a, b))
        self._count += len(a)
        if self._count >= _PAIRS_AT_ONCE:
            self.settle()

    def settle(self) -> np.ndarray:
        if self._held:
            a, b = (np.concatenate(x) for x in zip(*self._held, strict=True))
            self.label = smallest_labels(a, b, len(self.label), self.label)
            self._held, self._count = [], 0
        return self.label


def local_stars(prints: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components which close pairs with at least one home member form."""
    tree = build(prints, np.flatnonzero(home), _LEAF)
    union = _Union(len(prints))
    work = [(tree, np.arange(len(prints)))]
    while work:
        node, asking = work.pop()
        if not len(asking):
            continue
        if node.members is None:
            away = distances(prints[asking], node.vantage)
            work.append((node.near, asking[away - reach <= node.radius]))
            work.append((node.far, asking[away + reach > node.radius]))
            continue
        rows = max(1, _PAIRS_AT_ONCE // max(1, len(node.members)))
        for at in range(0, len(asking), rows):
            part = asking[at : at + rows]
            close = np.bitwise_count(prints[part][:, None] ^ prints[node.members][None, :]) <= reach
            i, j = np.nonzero(close)
            a, b = part[i], node.members[j]
            other = a != b
            if other.any():
                union.add(a[other], b[other])
    label = union.settle()
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked], prints[label[linked]]


def close_pairs(prints: np.ndarray, asking: np.ndarray, members: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of all pairs of ``asking`` and ``members`` that differ in at most ``reach`` bits, in parts."""
    work = [(build(prints, members, _LEAF), asking)]
    while work:
        node, open_to = work.pop()
        if not len(open_to):
            continue
        if node.members is None:
            away = distances(prints[open_to], node.vantage)
            work.append((node.near, open_to[away - reach <= node.radius]))
            work.append((node.far, open_to[away + reach > node.radius]))
            continue
        rows = max(1, _PAIRS_AT_ONCE // max(1, len(node.members)))
        for at in range(0, len(open_to), rows):
            part = open_to[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[node.members][None, :]) <= reach)
            yield part[i], node.members[j]


def close_links(prints: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` (distinct) differing in at most ``reach`` bits.

    ``prints`` is read three times; pass a checkpoint.
    """
    spark = prints.sparkSession
    many = prints.count()
    shards = max(1, many // max(SHARD_SIZE, min(MOST_SHARD_SIZE, many // SHARDS)))
    wanted = min(SAMPLE_LIMIT, SAMPLE_PER_SHARD * shards)
    # a hashed order is a random sample that every attempt repeats; nothing is collected for one shard
    rows = prints.orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect() if shards > 1 else []
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    tree = build(sample, np.arange(len(sample)), max(1, len(sample) // shards))
    for number, leaf in enumerate(leaves(tree)):
        leaf.number, leaf.members = number, np.zeros(0, np.int64)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["fp"].to_numpy(np.int64)
            for shard, who, home in route(tree, own.view(np.uint64), reach):
                yield pd.DataFrame({"shard": shard, "fp": own[who], "home": home})

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = local_stars(frame["fp"].to_numpy(np.int64).view(np.uint64), frame["home"].to_numpy(bool), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = prints.select("fp").mapInPandas(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(link, "a long, b long")
