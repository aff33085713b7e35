"""The prefix trie of conversations, by union-find over sorted-neighbour LCP edges in descending depth.

1. A turn becomes a code: 16 bytes of the digest of role and text, and the length of its text. A conversation is a path, its
   codes in a row; paths with their ids are dealt out by range and sorted, so that copies of one path spread by id.
2. A task has a stretch of sorted paths. Its edges are the common depths of neighbours; taken from the deepest on, each edge
   climbs the two components it connects to its depth and makes one node of what they have there. Nodes that hold neither the
   first nor the last path of the stretch are whole and written. All others lie on these two paths: they are
   contracted to what they have gathered so far, two paths a stretch.
3. FAN contracted stretches in order are sorted paths again, and are merged in the same way across their boundaries, until
   one stretch is left; in it all nodes are whole.
4. Parents that were not whole yet are looked up by the digest of their path, the frequent ones spread by SALT. The ids that
   end at such a node come as packed runs in order and are hashed one run after another, never held together.

Edge cases: null roles and texts are empty; turns without a number come first; turns of one number are ordered by their
code, repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; a
conversation that is rebuilt without turns is a member of the root; an empty table has no root; extra columns are
ignored. A task holds its stretch, and of one conversation 40 bytes a turn; texts stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CODE, GROUP, SHARES = 20, 5, 9
STRETCH, FAN, SALT, IDS = 50_000, 32, 16, 1 << 16

_OWN = "array<struct<depth: long, n: long, least: long, children: long, leaves: long, saved: long>>"
_FIELDS = f"kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, part long, side int, path binary, own {_OWN}, ids binary"
_COLUMNS = ["kind", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "parent_key", "part", "side", "path", "own", "ids"]
_INT = {k: pa.int64() for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "part")}
_SCHEMA = pa.schema([(c, _INT.get(c) or {"kind": pa.int32(), "side": pa.int32(), "ends_sha256": pa.string(), "own": pa.list_(pa.struct([(x, pa.int64()) for x in ("depth", "n", "least", "children", "leaves", "saved")]))}.get(c, pa.binary())) for c in _COLUMNS])
NODE, OPEN, ENDS = 0, 1, 2
NO_ONE = hashlib.sha256(b"").hexdigest()


def key_of(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


def common_depth(a: bytes, b: bytes) -> int:
    """How many leading codes two paths share."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    other = np.flatnonzero(x != y)
    return int(other[0] if len(other) else n) // CODE


class Node:
    """n members so far with the least id, and what whole subtrees below have: number, leaves, saved tokens."""

    __slots__ = ("depth", "path", "n", "least", "children", "leaves", "saved", "parent", "same", "whole")

    def __init__(self, depth: int, path: int, own: tuple | None):
        self.depth, self.path, self.parent, self.same, self.whole = depth, path, None, None, False
        self.n, self.least, self.children, self.leaves, self.saved = own or (0, None, 0, 0, 0)

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def found(self) -> Node:
        node = self
        while node.same is not None:
            node = node.same
        return node


class Forest:
    """The trie of paths in order. owns: for each path, what nodes on it have of their own, by depth.

    With open_ends, nodes of the first and the last path are not whole.
    """

    def __init__(self, paths: list[bytes], owns: list[dict[int, tuple]], open_ends: bool):
        self.paths, self.open_ends, self.nodes = paths, open_ends, []
        n = len(paths)
        self.up, self.first, self.last, self.rest = list(range(n)), list(range(n)), list(range(n)), owns
        self.top = [self._node(len(p) // CODE, i, i) for i, p in enumerate(paths)]
        edges = [common_depth(a, b) for a, b in zip(paths, paths[1:])]
        for e in np.argsort(-np.array(edges, np.int64), kind="stable").tolist():
            self._connect(self._root(e), self._root(e + 1), edges[e])
        root = self._root(0)
        self._climb(root, 0)
        self._finish(self.top[root], root)

    def _node(self, depth: int, path: int, component: int) -> Node:
        node = Node(depth, path, self.rest[component].pop(depth, None))
        self.nodes.append(node)
        return node

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def _finish(self, node: Node, component: int) -> None:
        """All that lies below has been added: the node is whole, unless paths of other stretches may pass it."""
        node.whole = not (self.open_ends and (self.first[component] == 0 or self.last[component] == len(self.paths) - 1))
        if node.whole:
            node.leaves = node.leaves or 1
            if node.depth:
                end = node.depth * CODE
                node.saved += (node.n - 1) * int.from_bytes(self.paths[node.path][end - 4 : end], "big")

    def _climb(self, c: int, depth: int) -> None:
        while self.top[c].depth > depth:
            node = self.top[c]
            self._finish(node, c)
            node.parent = self.top[c] = self._node(node.depth - 1, self.first[c], c)
            if node.whole:
                node.parent.add(node.n, node.least, 1, node.leaves, node.saved)

    def _connect(self, a: int, b: int, depth: int) -> None:
        self._climb(a, depth)
        self._climb(b, depth)
        if len(self.rest[a]) < len(self.rest[b]):
            a, b = b, a
        for at, own in self.rest[b].items():
            if at in self.rest[a]:
                held = Node(at, 0, self.rest[a][at])
                held.add(*own)
                own = held.n, held.least, held.children, held.leaves, held.saved
            self.rest[a][at] = own
        keep, gone = self.top[a], self.top[b]
        keep.add(gone.n, gone.least, gone.children, gone.leaves, gone.saved)
        keep.path, gone.same, self.up[b] = min(keep.path, gone.path), keep, a
        self.first[a], self.last[a] = min(self.first[a], self.first[b]), max(self.last[a], self.last[b])
        self.rest[b] = {}

    def rows(self, part: int, ends: dict[tuple[int, int], str] | None) -> Iterator[dict]:
        """Whole nodes, then the contracted paths. ends: hashes by path and depth; without them nodes get their key."""
        spine: list[dict[int, Node]] = [{}, {}]
        for node in self.nodes:
            if node.same is not None:
                continue
            path = self.paths[node.path]
            if not node.whole:
                spine[0 if node.path == 0 else 1][node.depth] = node
                continue
            parent = node.parent and node.parent.found()
            row = {"kind": NODE, "conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
            if parent is not None and parent.whole:
                row["parent_conv_id"] = parent.least
            elif parent is not None:
                row["parent_key"] = key_of(path[: parent.depth * CODE])
            if ends is None:
                row["key"] = key_of(path[: node.depth * CODE])
            else:
                row["ends_sha256"] = ends.get((node.path, node.depth), NO_ONE)
            yield row
        if self.open_ends:
            for side, path in enumerate(self.paths[:1] + self.paths[1:][-1:]):
                own = [{"depth": d, "n": x.n, "least": x.least, "children": x.children, "leaves": x.leaves, "saved": x.saved} for d, x in spine[side].items() if x.n]
                yield {"kind": OPEN, "part": part, "side": side, "path": path, "own": own}


def packed(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.diff(ids, prepend=ids[:1]).astype("<i8").tobytes()) + ids[:1].astype("<i8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[:-8]), "<i8")) + np.frombuffer(data[-8:], "<i8")


def decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _stretch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, conv_id and part in order, of one partition."""
    paths, members, part = [], [], 0
    for p in parts:
        for path, conv_id, number in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), p.column(2).to_pylist(), strict=True):
            part = number
            if not paths or paths[-1] != path:
                paths.append(path), members.append([])
            members[-1].append(conv_id)
    if not paths:
        return
    first, last = paths[0], paths[-1]
    ends, runs = {}, []
    for i, (path, ids) in enumerate(zip(paths, members, strict=True)):
        ids = np.array(ids, np.int64)
        if first.startswith(path) or last.startswith(path):  # the node is not whole yet
            runs += [{"kind": ENDS, "key": key_of(path), "conv_id": int(ids[k]), "ids": packed(ids[k : k + IDS])} for k in range(0, len(ids), IDS)]
        else:
            ends[i, len(path) // CODE] = hashlib.sha256(decimal(ids)).hexdigest()
    forest = Forest(paths, [{len(p) // CODE: (len(m), min(m), 0, 0, 0)} for p, m in zip(paths, members, strict=True)], True)
    yield from _table([*forest.rows(part, ends), *runs])


def _table(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], _SCHEMA)


def _merge(open_ends: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "side"])
        owns = [{x["depth"]: (x["n"], x["least"], x["children"], x["leaves"], x["saved"]) for x in own} for own in rows["own"]]
        forest = Forest([bytes(p) for p in rows["path"]], owns, open_ends)
        found = list(forest.rows(int(rows["part"].iloc[0]) // FAN, None))
        return pa.Table.from_pylist(found, _SCHEMA).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)

    return run


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and hash of its ids, from runs in order of key and first id."""
    last, state = None, None
    for p in parts:
        done = []
        for key, ids in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(decimal(unpacked(ids)))
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "sha": pa.array([h for _, h in done], pa.string())})
    if last is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([last], pa.binary()), "sha": pa.array([state.hexdigest()], pa.string())})


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and the hex text of its path, from conv_id, turn, role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE - 8)
    code = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))
    codes = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", code.alias("code")).alias("x"))
    return codes.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["code"]), "").alias("path"))


def rebuilt(whole: DataFrame) -> DataFrame:
    """conv_id and path: the first turns of the group's first conversation, then its own after as many."""
    head = 2 * CODE * (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES)
    base = whole.toDF("base", "base_path")
    joined = whole.withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(GROUP))).join(base, "base", "left")
    own = F.substring(F.col("path"), head + 1, F.length("path"))
    return joined.select("conv_id", F.unhex(F.concat(F.substring(F.coalesce("base_path", F.lit("")), F.lit(1), head), own)).alias("path"))


def prefix_trie(found: DataFrame) -> DataFrame:
    """One row a node, from conv_id and path (codes in a row), one row a conversation."""
    spark = found.sparkSession
    found = materialize(found)
    turns = found.agg(F.sum(F.octet_length("path") / CODE + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(turns) // STRETCH))
    dealt = found.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    tables = [materialize(dealt.select("path", "conv_id", F.spark_partition_id().cast("long").alias("part")).mapInArrow(_stretch, _FIELDS))]
    parts = (tables[0].where(F.col("kind") == OPEN).agg(F.max("part")).first()[0] or 0) + 1
    while True:
        spread = tables[-1].where(F.col("kind") == OPEN).withColumn("group", F.floor(F.col("part") / FAN))
        parts = -(-parts // FAN)
        tables.append(materialize(spread.groupBy("group").applyInPandas(_merge(parts > 1), _FIELDS)))
        if parts == 1:
            break
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    runs = tables[0].where(F.col("kind") == ENDS).select("key", "ids", "conv_id")
    hashes = runs.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(_hashed, "key binary, sha string")
    late = tables[1].where(F.col("kind") == NODE)
    for t in tables[2:]:
        late = late.unionByName(t.where(F.col("kind") == NODE))
    late = materialize(late.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ONE))).drop("sha"))
    early = tables[0].where(F.col("kind") == NODE)
    rows = early.unionByName(late)
    known = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found_id"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    waiting = rows.where("parent_key IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int"))
    joined = waiting.join(known, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("found_id"))
    return rows.where("parent_key IS NULL").select(*result).unionByName(joined.select(*result))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = materialize(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(rebuilt(whole))
