"""MinHash near-dedup with fast similarity sketches.

Sketch: rounds place every shingle into a bin by a hash of the round; a bin keeps its least (round, hash) value.
After the first rounds that fill all bins, later ones cannot change them, so a long text needs one round and a short
one a few; round T + i puts everything into bin i, so no bin stays empty. The share of equal bins of two sets has the
mean and the concentration of independent minima.

Links: rows with equal shingle sets form a class, and only class representatives (least doc_id) go on. Their sketches
are cut into bands; at the thresholds used here a pair that reaches the threshold misses all of the bands with a
probability below 1e-6. Within a band's bucket members are linked to the bucket's least member first, so that a large
group of copies costs a pair for each member and band, not one for each two. Where a bucket still has several
components (of buckets with the same members, one), their members are compared in packs, all pairs of two packs in one step, and only what connects them is
passed on. Every link is confirmed on the full sets of 64-bit shingle hashes, built again from the whole texts.

Edge cases: texts of null or without a word have an empty set, link with nothing and are kept; texts with fewer words
than a shingle have one shingle, all their words; repeated rows share a class; rows that share a doc_id but not the
text are separate until linked, and the doc_id's component is then that of its own row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, discard, documents, free_names, materialize, mix, raw

BINS, BAND = 120, 4
CACHE = 300_000
#: A pair whose sketches agree in fewer bins than this share is no candidate; at the thresholds used, 6 standard deviations away.
SLACK = 0.22
PACK, PACK_SHINGLES = 384, 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes, k: int, words: _WordHash) -> np.ndarray:
    """The set of hashes of k-word shingles, sorted."""
    found = text.translate(_LOWER).split()
    if len(found) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)] if found else [], np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(h) - k + 1
    whole = h[:n] * _M[0]
    for i in range(1, k):
        whole = mix(whole + h[i : n + i]) * _M[i % 5]
    return np.unique(whole)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """16 bits of each bin's least (round, hash)."""
    out, filled, first = np.zeros(bins, np.uint64), np.zeros(bins, bool), 0
    low = np.uint64((1 << 48) - 1)
    while not filled.all():
        rounds = np.arange(first, min(2 * bins, first + max(1, 1200 // len(items))), dtype=np.uint64)[:, None]
        v = mix(items[None, :] + (rounds + np.uint64(1)) * _M[3])
        b = np.where(rounds < bins, (v >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16), rounds % np.uint64(bins))
        key = np.sort((b << np.uint64(56) | rounds << np.uint64(48) | v & low).ravel())
        own = (key >> np.uint64(56)).astype(np.int64)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        new = at[~filled[own[at]]]
        out[own[new]], filled[own[new]] = key[new], True
        first += len(rounds)
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key (md5 of the text), n, set_key (of the shingle set) and sketch of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()

        def one(doc_id: int | None, text: bytes, key: str) -> tuple:
            if not len(s := shingles(text, k, words)):
                return doc_id, key, 0, None, None
            return doc_id, key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tobytes()

        yield from batches((one(i, t, x) for p in parts for i, t, x in zip(p.column(0).to_pylist(), raw(p.column(1)), p.column(2).to_pylist(), strict=True)), schema)

    return docs.select("doc_id", "text", F.md5("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key string, n long, set_key binary, sketch binary")


def _agreeing(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of pairs whose sketches agree in enough bins."""
    least = (threshold - SLACK) * BINS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint16).reshape(len(p), BINS) for c in ("sa", "sb"))
                yield p.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """node and text of each of the distinct nodes: the text of its representative's own row, found by doc_id, so that
    no task meets all copies of a text."""
    wanted = nodes.join(reps.select("node", "doc_id", "text_key"), "node")
    found = docs.select("doc_id", "text").join(wanted, "doc_id").where(F.md5("text") == F.col("text_key"))
    return found.groupBy("doc_id", "text_key", "node").agg(F.any_value("text").alias("text")).select("node", "text")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """a, b of pairs whose full shingle sets reach the threshold."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, percent = _WordHash(), round(threshold * 100)
        last: tuple = (None, None)
        for p in parts:
            keep = []
            for x, y in zip(raw(p.column("xa")), raw(p.column("xb")), strict=True):
                if last[0] != x:
                    last = x, shingles(x, k, words)
                s, t = last[1], shingles(y, k, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(docs, nodes, reps))
    full = pairs.join(texts.toDF("a", "xa"), "a").join(texts.toDF("b", "xb"), "b")
    links = materialize(full.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long"))
    discard(texts)
    return links


def _pairs(found: DataFrame, reps: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Confirmed links among distinct pairs (a, b) of representatives."""
    r = reps.select("node", "sketch")
    near = materialize(_agreeing(found.join(r.toDF("a", "sa"), "a").join(r.toDF("b", "sb"), "b"), threshold))
    links = _confirmed(near, reps, docs, k, threshold)
    discard(near)
    return links


def _across(rest: DataFrame, reps: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) that connect what the confirmed links between different components of a bucket connect.

    rest: band, bucket, node, n, c of all members of such buckets. They are dealt to packs of about PACK_SHINGLES
    shingles and at most about PACK members; a component that fills a pack has packs of its own, which are not compared
    with one another. Each two other packs of a bucket meet in one row, and all their pairs are compared there at once.
    """
    own = rest.groupBy("band", "bucket", "c").agg(F.sum("n").alias("sn"), F.count(F.lit(1)).alias("m"))
    packs = F.ceil(F.greatest(F.col("sn") / PACK_SHINGLES, F.col("m") / PACK)).cast("int")
    own = own.withColumn("pack_c", F.when(packs > 1, F.col("c")))
    counts = own.groupBy("band", "bucket", "pack_c").agg(F.sum("sn").alias("sn"), F.sum("m").alias("m")).withColumn("packs", packs).drop("sn", "m")
    dealt = (
        rest.join(own.select("band", "bucket", "c", "pack_c"), ["band", "bucket", "c"])
        .join(counts.toDF("band", "bucket", "pc", "packs"), ["band", "bucket"])
        .where(F.col("pack_c").eqNullSafe(F.col("pc")))
        .withColumn("pack", F.pmod(F.xxhash64("node"), F.col("packs").cast("long")).cast("int"))
    )
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        yield from batches(((i, shingles(t, k, words).tobytes()) for p in parts for i, t in zip(p.column(0).to_pylist(), raw(p.column(1)), strict=True)), schema)

    texts = _texts(docs, rest.select("node").distinct(), reps)
    items = materialize(texts.mapInArrow(sets, "node long, items binary"))
    key = ["band", "bucket", "pc", "pack"]
    full = materialize(dealt.join(items, "node").groupBy(*key).agg(F.collect_list(F.struct("node", "c", "items")).alias("members")))
    x, y = full.toDF("band", "bucket", "pc", "pack", "left"), full.toDF("band", "bucket", "qc", "qack", "right")
    ahead = F.struct(F.coalesce("pc", F.lit(-(1 << 63))), "pack") <= F.struct(F.coalesce("qc", F.lit(-(1 << 63))), "qack")
    met = x.join(y, ["band", "bucket"]).where(ahead & (F.col("pc").isNull() | ~F.col("pc").eqNullSafe(F.col("qc"))))
    percent = round(threshold * 100)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for i in range(len(p)):
                left, right = (p.column(j)[i].as_py() for j in (0, 1))
                a, b = (np.array([m["node"] for m in side], np.int64) for side in (left, right))
                c, d = (np.array([m["c"] for m in side], np.int64) for side in (left, right))
                found = [[np.frombuffer(m["items"], np.uint64) for m in side] for side in (left, right)]
                both, (na, nb) = _common(*found), (np.array([len(s) for s in side]) for side in found)
                linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (c[:, None] != d[None, :])
                pairs = _spanning(a, b, linked)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    links = materialize(met.select("left", "right").mapInArrow(compare, "a long, b long").distinct())
    discard(items, full)
    return links


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each left set shares with each right set."""
    (x, own_x), (y, own_y) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(i) for i in s])) for s in (left, right))
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    place = []
    for v, own in ((x, own_x), (y, own_y)):
        at = np.searchsorted(shared, v)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == v[hit]
        place.append((at[hit], own[hit]))
    for start in range(0, len(shared), 4096):  # so many columns at a time
        grids = []
        for (at, own), n in zip(place, out.shape, strict=True):
            here = (at >= start) & (at < start + 4096)
            grid = np.zeros((n, min(4096, len(shared) - start)), np.float32)
            grid[own[here], at[here] - start] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _spanning(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a node and the least node that links connect it with."""
    some_a, some_b = linked.any(1), linked.any(0)
    a, b, linked = a[some_a], b[some_b], linked[some_a][:, some_b]
    la, lb, big = a.copy(), b.copy(), np.iinfo(np.int64).max
    while len(a):
        ma = np.minimum(la, np.where(linked, lb[None, :], big).min(1))
        mb = np.minimum(lb, np.where(linked, ma[:, None], big).min(0))
        if (ma == la).all() and (mb == lb).all():
            break
        la, lb = ma, mb
    n, l = np.concatenate([a, b]), np.concatenate([la, lb])
    return n[n != l], l[n != l]


def components(links: DataFrame) -> DataFrame:
    """node, component (least node) of all nodes in links (a, b). Each round halves the distance to the least node."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = held = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = edges.join(labels.toDF("b", "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.toDF("next", "far")
        step = materialize(step.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        discard(held)
        held, moved = step, step.where("next <> component").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not moved:
            discard(edges)
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key of each row."""
    rows = materialize(sketches(docs, k))
    least = F.min(F.struct("doc_id", "text_key", "n", "sketch")).alias("r")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("set_key").agg(least).select("set_key", "r.*")
    # a node is a class: its least doc_id, unless rows of several classes share that
    node = F.when(F.count(F.lit(1)).over(Window.partitionBy("doc_id")) == 1, F.col("doc_id")).otherwise(-1 - F.abs(F.xxhash64("set_key") / 2).cast("long"))
    reps = materialize(classes.withColumn("node", node))
    band = F.expr(f"transform(sequence(0, {BINS // BAND - 1}), i -> xxhash64(i, substring(sketch, i * {2 * BAND} + 1, {2 * BAND})))")
    banded = reps.select("node", "n", F.posexplode(band).alias("band", "bucket"))
    hubs = banded.groupBy("band", "bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(banded.join(hubs.select("band", "bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), ["band", "bucket"]))
    close = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(threshold - 1e-9)
    stars = shared.where((F.col("node") != F.col("hub")) & close(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _pairs(stars, reps, docs, k, threshold)
    labels = components(links)
    # what the stars left apart within a bucket is compared in packs of members
    named = shared.join(labels, "node", "left").select("band", "bucket", "node", "n", F.coalesce("component", "node").alias("c"))
    open_ = named.groupBy("band", "bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("band", "bucket")
    rest = named.join(open_, ["band", "bucket"], "left_semi")
    # near texts share several buckets: those with the same members are compared once
    members = [F.count(F.lit(1)).alias("m"), F.min("node").alias("x"), F.max("node").alias("y"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h")]
    same = rest.groupBy("band", "bucket").agg(*members).groupBy("m", "x", "y", "h").agg(F.min(F.struct("band", "bucket")).alias("one"))
    rest = materialize(rest.join(same.select("one.*"), ["band", "bucket"], "left_semi"))
    more = _across(rest, reps, docs, k, threshold)
    labels = components(links.union(more))
    discard(shared, rest, links, more)
    named = reps.select("node", "set_key", F.col("doc_id").alias("least")).join(labels, "node", "left")
    # components are named by their least doc_id
    names = named.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("least").alias("component_id"))
    classes = named.select("set_key", F.coalesce("component", "node").alias("c")).join(names, "c").select("set_key", "component_id")
    out = rows.join(classes, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def deduplicated(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that are kept: one of each component; of repeated rows with one doc_id and text, one."""
    found = near_duplicates(docs, k, threshold).where("kept").groupBy("doc_id", "text_key").agg(F.any_value("n_shingles").alias("n"))
    key, own, text = free_names(docs.columns, "_key", "_id", "_text")
    keyed = docs.withColumn(key, F.md5("text")).dropDuplicates(["doc_id", key])
    found = found.select(F.col("doc_id").alias(own), F.col("text_key").alias(text))
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col(own)) & F.col(key).eqNullSafe(F.col(text)), "left_semi").drop(key)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words a shingle, similarity 0.85."""
    return near_duplicates(documents(spark, sf_dir), 3, 0.85).drop("text_key")
