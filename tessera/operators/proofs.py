"""Hash trees over operation logs and active keys: roots, proofs of locations, batches, keys, absence and ranges.

The tree is this engine's own: leaves are sha256(00 ‖ location ‖ content), inner nodes sha256(01 ‖ left ‖
right), and a node without a right sibling goes up as it is.  It is built level by level with DataFrame
functions (a level halves the rows), so a log of any length is hashed in parallel.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize


class ProofError(ValueError):
    """A proof that does not verify, or that cannot be made."""


def leaf_bytes(location: int, key: bytes | None, value: bytes | None) -> bytes:
    part = lambda b: b"\x00" if b is None else b"\x01" + len(b).to_bytes(8, "big") + b
    return location.to_bytes(8, "big") + part(key) + part(value)


def hash_leaf(content: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + content).digest()


def hash_pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def leaf_hash(location: str, key: str, value: str) -> Column:
    """hash_leaf() of leaf_bytes() of columns."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit(bytearray(b"\x00"))).otherwise(F.concat(F.lit(bytearray(b"\x01")), F.unhex(F.lpad(F.hex(F.length(c).cast("long")), 16, "0")), F.col(c)))
    content = F.concat(F.lit(bytearray(b"\x00")), F.unhex(F.lpad(F.hex(F.col(location).cast("long")), 16, "0")), part(key), part(value))
    return F.unhex(F.sha2(content, 256))


def _leaf(ops: DataFrame, location: str, key: str, value: str) -> DataFrame:
    return ops.select(F.lit(0).alias("level"), F.col(location).cast("long").alias("i"), leaf_hash(location, key, value).alias("h"))


@dataclass(frozen=True)
class Proof:
    """``siblings`` are (level, index, hash) that with the leaves give the root."""

    size: int
    locations: tuple[int, ...]
    siblings: tuple[tuple[int, int, bytes], ...]


class HashTree:
    """Of binary keys and values at dense locations from 0."""

    def __init__(self, ops: DataFrame, location: str = "location", key: str = "key", value: str = "value"):
        level = materialize(_leaf(ops, location, key, value), "tree")
        self.size = level.count()
        if self.size and level.agg(F.max("i")).first()[0] != self.size - 1:
            raise ProofError("locations have holes")
        self.levels = [level]
        n = self.size
        while n > 1:
            pairs = self.levels[-1].groupBy(F.shiftright("i", 1).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("p"))
            inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(b"\x01")), F.col("p")[0]["h"], F.try_element_at("p", F.lit(2))["h"]), 256))
            up = F.when(F.size("p") == 1, F.col("p")[0]["h"]).otherwise(inner)
            self.levels.append(materialize(pairs.select(F.lit(len(self.levels)).alias("level"), "i", up.alias("h")), "tree"))
            n = (n + 1) // 2

    def root(self) -> bytes:
        return bytes(self.levels[-1].first().h) if self.size else hashlib.sha256(b"").digest()

    def prove(self, locations: list[int]) -> Proof:
        """A proof of any set of locations; hashes that the verifier can compute are left out."""
        own = set(locations)
        if not own or min(own) < 0 or max(own) >= self.size:
            raise ProofError("a location is not in the tree")
        need, at, n = [], own, self.size
        for level in range(len(self.levels) - 1):
            need += [(level, i ^ 1) for i in at if i ^ 1 not in at and i ^ 1 < n]
            at, n = {i >> 1 for i in at}, (n + 1) // 2
        found = {}
        for level in {lv for lv, _ in need}:
            ids = [i for lv, i in need if lv == level]
            found |= {(level, r.i): bytes(r.h) for r in self.levels[level].filter(F.col("i").isin(ids)).collect()}
        return Proof(self.size, tuple(sorted(own)), tuple((lv, i, found[lv, i]) for lv, i in sorted(need)))


def verify(root: bytes, proof: Proof, leaves: dict[int, bytes]) -> None:
    """Raise unless the leaves' contents (leaf_bytes) are what the root holds at their locations."""
    if implied_root(proof, leaves) != root:
        raise ProofError("the root differs")


def implied_root(proof: Proof, leaves: dict[int, bytes]) -> bytes:
    """The root that the leaves' contents and the proof's siblings make."""
    if set(leaves) != set(proof.locations) or not leaves:
        raise ProofError("the leaves are not the proof's")
    known = {(lv, i): h for lv, i, h in proof.siblings}
    at, n, level = {i: hash_leaf(c) for i, c in leaves.items()}, proof.size, 0
    while n > 1:
        up = {}
        for i, h in at.items():
            other = at.get(i ^ 1, known.get((level, i ^ 1)))
            if other is None and (i ^ 1) < n:
                raise ProofError("a sibling is missing")
            up[i >> 1] = h if other is None else hash_pair(*((h, other) if i % 2 == 0 else (other, h)))
        at, n, level = up, (n + 1) // 2, level + 1
    if set(at) != {0}:
        raise ProofError("a location is beyond the tree")
    return at[0]


# small trees, on the driver or a client


def _levels(hashes: list[bytes]) -> list[list[bytes]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        h = levels[-1]
        levels.append([hash_pair(h[i], h[i + 1]) if i + 1 < len(h) else h[i] for i in range(0, len(h), 2)])
    return levels


def tree_root(hashes: list[bytes]) -> bytes:
    return _levels(hashes)[-1][0] if hashes else hashlib.sha256(b"").digest()


def prove_leaves(hashes: list[bytes], locations: list[int]) -> Proof:
    """As HashTree.prove(), of leaves at hand."""
    own, levels = set(locations), _levels(hashes)
    if not own or min(own) < 0 or max(own) >= len(hashes):
        raise ProofError("a location is not in the tree")
    siblings, at = [], own
    for level, row in enumerate(levels[:-1]):
        siblings += [(level, i ^ 1, row[i ^ 1]) for i in sorted(at) if i ^ 1 not in at and i ^ 1 < len(row)]
        at = {i >> 1 for i in at}
    return Proof(len(hashes), tuple(sorted(own)), tuple(siblings))


def chain(before: bytes, root: bytes) -> bytes:
    """The head of a batch: it binds the batch's root and the head before."""
    return hashlib.sha256(b"\x02" + before + root).digest()


@dataclass(frozen=True)
class BatchProof:
    """Of operations of one batch: its first location, the head before it, and a proof in the batch's own tree."""

    first: int
    before: bytes
    proof: Proof


def verify_batch(head: bytes, batch: BatchProof, leaves: dict[int, bytes]) -> None:
    """Raise unless the leaves' contents are what the batch whose head is ``head`` holds at their locations."""
    own = {i - batch.first: c for i, c in leaves.items()}
    if set(own) != set(batch.proof.locations):
        raise ProofError("the leaves are not the proof's")
    if chain(batch.before, implied_root(batch.proof, own)) != head:
        raise ProofError("the head differs")


# frontiers: what is left of a log whose earlier operations are not at hand


@dataclass
class Frontier:
    """Roots of the whole subtrees that the first ``size`` leaves make, largest first.

    They give the root at ``size`` and, with the leaves after it, every later root, so a log is continued and
    checked from a boundary without the operations before it.
    """

    size: int = 0
    peaks: tuple[bytes, ...] = ()

    def append(self, leaf: bytes) -> None:
        """Add the hash of one more leaf."""
        peaks, n = [*self.peaks, leaf], self.size
        while n & 1:
            right = peaks.pop()
            peaks[-1] = hash_pair(peaks[-1], right)
            n >>= 1
        self.size, self.peaks = self.size + 1, tuple(peaks)

    def root(self) -> bytes:
        if not self.size:
            return hashlib.sha256(b"").digest()
        out = self.peaks[-1]
        for p in reversed(self.peaks[:-1]):
            out = hash_pair(p, out)
        return out


def frontier(tree: HashTree, size: int | None = None) -> Frontier:
    """The frontier of the tree's first ``size`` leaves (default: all)."""
    size = tree.size if size is None else size
    if not 0 <= size <= tree.size:
        raise ProofError(f"{size} of {tree.size} leaves")
    peaks, at = [], 0
    for level in reversed(range(size.bit_length())):
        if size >> level & 1:
            peaks.append(bytes(tree.levels[level].filter(F.col("i") == at >> level).first().h))
            at += 1 << level
    return Frontier(size, tuple(peaks))


# keys


@dataclass(frozen=True)
class KeyEntry:
    """A leaf of a tree of keys: its place, key, value, and the next key in order (the last one's is the first)."""

    place: int
    key: bytes
    value: bytes
    next_key: bytes

    def content(self) -> bytes:
        return leaf_bytes(self.place, self.key, _packed(self.value, self.next_key))

    def spans(self, key: bytes) -> bool:
        """Whether ``key`` lies strictly between this key and the next one."""
        if self.key < self.next_key:
            return self.key < key < self.next_key
        return key > self.key or key < self.next_key


def _packed(value: bytes, next_key: bytes) -> bytes:
    return len(value).to_bytes(8, "big") + value + next_key


@dataclass(frozen=True)
class KeyProof:
    entries: tuple[KeyEntry, ...]
    proof: Proof


class KeyTree:
    """A tree of active keys in order, each bound to the next one, so that presence, absence and whole ranges can
    be proven against its root.  ``active`` has binary ``key`` and ``value``, each key once.

    Keys are numbered by ranges and prefix sums; no task sees all of them.
    """

    def __init__(self, active: DataFrame, key: str = "key", value: str = "value"):
        from pyspark.sql import Window

        from ..sources.tables import by_ranges

        part = by_ranges(active.select(F.col(key).alias("key"), F.col(value).alias("value")), "key", label="keys")
        own, order = Window.partitionBy("_p").orderBy("key"), Window.orderBy("_p")  # the second over a row a range
        sums = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_first"))
        after = F.coalesce(F.lead("_first").over(order), F.min("_first").over(Window.partitionBy()))
        sums = sums.select(F.col("_p").alias("_q"), (F.sum("_n").over(order) - F.col("_n")).alias("_base"), after.alias("_after"))
        rows = part.withColumn("_i", F.row_number().over(own) - 1).withColumn("_next", F.lead("key").over(own))
        rows = rows.join(F.broadcast(sums), F.col("_p") == F.col("_q"))
        rows = rows.select((F.col("_base") + F.col("_i")).cast("long").alias("location"), "key", "value", F.coalesce("_next", "_after").alias("next_key"))
        self.rows = materialize(rows, "key_tree")
        packed = F.concat(F.unhex(F.lpad(F.hex(F.length("value").cast("long")), 16, "0")), "value", "next_key")
        self.tree = HashTree(self.rows.select("location", "key", packed.alias("value")))

    def root(self) -> bytes:
        return self.tree.root()

    def _prove(self, where) -> KeyProof:
        got = self.rows.filter(where).orderBy("location").collect()
        if not got:
            raise ProofError("there is no such key")
        entries = tuple(KeyEntry(r.location, bytes(r.key), bytes(r.value), bytes(r.next_key)) for r in got)
        return KeyProof(entries, self.tree.prove([e.place for e in entries]))

    def prove(self, keys: list[bytes]) -> KeyProof:
        """That each of ``keys`` is there with its value; one that is not raises."""
        proof = self._prove(F.col("key").isin([bytearray(k) for k in set(keys)]))
        if len(proof.entries) != len(set(keys)):
            raise ProofError("a key is not there")
        return proof

    def _span(self, key: bytes):
        k = F.lit(bytearray(key))
        inner = (F.col("key") < k) & (k < F.col("next_key"))
        return inner | ((F.col("next_key") <= F.col("key")) & ((k > F.col("key")) | (k < F.col("next_key"))))

    def prove_absent(self, key: bytes) -> KeyProof:
        """That ``key`` is not there: the neighbour that spans it."""
        return self._prove(self._span(key))

    def prove_range(self, start: bytes, end: bytes) -> KeyProof:
        """All keys of [start, end), and the one before them if ``start`` is not there; a bounded range."""
        inside = (F.col("key") >= F.lit(bytearray(start))) & (F.col("key") < F.lit(bytearray(end)))
        return self._prove(inside | self._span(start))


def _verified(root: bytes, proof: KeyProof) -> None:
    verify(root, proof.proof, {e.place: e.content() for e in proof.entries})


def verify_keys(root: bytes, proof: KeyProof) -> dict[bytes, bytes]:
    """The keys and values that the proof shows to be there."""
    _verified(root, proof)
    return {e.key: e.value for e in proof.entries}


def verify_absent(root: bytes, proof: KeyProof, key: bytes) -> None:
    _verified(root, proof)
    if len(proof.entries) != 1 or not proof.entries[0].spans(key):
        raise ProofError("the proof does not span the key")


def verify_range(root: bytes, proof: KeyProof, start: bytes, end: bytes) -> dict[bytes, bytes]:
    """All keys of [start, end) with their values: each entry's next key is the next entry, from one at or before
    ``start`` to one whose next key is not below ``end``."""
    _verified(root, proof)
    inside = sorted((e for e in proof.entries if start <= e.key < end), key=lambda e: e.key)
    spanning = next((e for e in proof.entries if e.spans(start)), None)
    if not spanning and (not inside or inside[0].key != start):
        raise ProofError("the range's beginning is not proven")
    links = [*([spanning] if spanning else []), *inside]
    # the key before the range may be its last one, which links to the first
    if any(a.next_key != b.key for a, b in zip(links, links[1:], strict=False)):
        raise ProofError("a key of the range may be missing")
    last = links[-1]
    wraps = last.next_key <= last.key and (bool(inside) or last.key < start)
    if not (wraps or last.next_key >= end):
        raise ProofError("the range's end is not proven")
    return {e.key: e.value for e in inside}
