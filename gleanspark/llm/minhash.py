"""Near-duplicate documents by circulant MinHash.

Two permutations make all coordinates of a signature: one scatters a document's shingles over a circle of 2**32
places, the other, shifted around the circle by 1, 2, 3 ... places, ranks them; the k-th coordinate is the smallest
rank under the k-th shift. Coordinates are banded, and documents that share a band are compared by the exact Jaccard
similarity of their whole sets. With 32 bands of 4, a pair at 0.8 escapes all bands with a probability of 5e-8.

Documents with equal sets are one node. In each bucket all are compared with the smallest node. What then is still
apart within a bucket is compared there by outlines, which bound the similarity from above (outlines.py). Nodes
connected by pairs that outlines can't tell apart form a group, and those outside the group's largest component are
compared, in packs of bounded size, with the whole group by their texts. So each pair that shares a band is compared,
proven to be unlike or known to be connected, and no bucket's pairs are ever listed: a line that many documents share
fills large buckets and chains them, but their texts are not sent around for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import few_rows_a_batch, materialize, parcels, prepared, text_of
from gleanspark.llm.components import components
from gleanspark.llm.outlines import Outlines, outline
from gleanspark.llm.shingles import scrambled, shingle_sets

BANDS, BAND_ROWS = 32, 4
#: Ids up to this many may be broadcast to pick their texts; beyond it a shuffle does so.
BROADCAST_IDS = 1_000_000
#: Characters of texts in a pack of the second look, and bytes of outlines in one: about so many, one node at least.
FEW, MANY = 250_000, 1_000_000
FEW_BYTES, MANY_BYTES = 125_000, 500_000


def ranks(places: np.ndarray, shift: int, out: np.ndarray) -> np.ndarray:
    """The second permutation of the circle, shifted: one-to-one, as each step is."""
    np.add(places, np.uint32(shift), out=out)
    out *= np.uint32(0x9E3779B1)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA77)
    out ^= out >> np.uint32(13)
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """size coordinates by non-empty set."""
    if not sets:
        return np.zeros((0, size), np.uint32)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    # the first permutation: shingles are already scattered numbers
    places = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    room = np.empty_like(places)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(ranks(places, k + 1, room), start)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key by document and band."""
    x = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        x = scrambled(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows].astype(np.uint64))
    return x.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()  # of bytes: A-Z only


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reached by links, itself included), kept, for every row.

    Links join documents whose sets of `width`-word shingles (A-Z lower-cased) have a Jaccard similarity of `percent`
    / 100 or more. Null, empty and blank texts have no shingles and link with nothing. Rows that repeat a doc_id are
    one document, of one component, that links with what any of its texts does. A row without an id links with nothing: component_id is
    null and it is kept. An empty table gives no rows; other columns are not looked at.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, keys = [], [], []
            for part in parcels(b.column(1)):
                sets = shingle_sets([_raw(t) for t in part], width)
                full = [s for s in sets if len(s)]
                banded = iter(band_keys(signatures(full, bands * band_rows), bands, band_rows))
                for s in sets:
                    n.append(len(s))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(next(banded).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "key", "bands"])

    signed = materialize(rows.mapInArrow(sign, "doc_id long, n_shingles long, key binary, bands binary"), "minhash-signed")
    classes = materialize(signed.where("key is not null and doc_id is not null").groupBy("key", "bands").agg(F.min("doc_id").alias("id")), "minhash-classes")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), bands)), pa.array(keys)], names=["id", "bucket"])

    members = classes.select("id", "bands").mapInArrow(split, "id long, bucket long")
    hubs = materialize(members.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other")).where("hub <> other").drop("other"), "minhash-hubs")
    shared = materialize(members.join(hubs, "bucket"), "minhash-shared")
    tried = materialize(shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "minhash-tried")

    involved = materialize(tried.select(F.col("a").alias("doc_id")).union(tried.select("b")).distinct(), "minhash-ids")
    few = involved.count() <= BROADCAST_IDS
    texts = materialize(rows.join(F.broadcast(involved) if few else involved, "doc_id", "left_semi"), "minhash-texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: tuple[int, str, np.ndarray] | None = None
            yes = []
            for a_text, hub, hub_text in zip(b.column(2), b.column(1), b.column(3), strict=True):
                hub, hub_text = hub.as_py(), hub_text.as_py()
                if kept is None or kept[0] != hub or kept[1] != hub_text:
                    kept = (hub, hub_text, shingle_sets([_raw(hub_text)], width)[0])
                yes.append(alike(shingle_sets([_raw(a_text.as_py())], width)[0], kept[2], percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    of_a = tried.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    of_both = of_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    with few_rows_a_batch(docs.sparkSession, 500):
        links = materialize(of_both.select("a", "b", "a_text", "b_text").mapInArrow(confirm, "a long, b long"), "minhash-links")
    twice = signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = not twice.isEmpty()
    if again:  # the classes of a document's texts
        own = materialize(signed.join(twice, "doc_id", "left_semi").select("doc_id", "key").distinct().join(classes.select("key", "id"), "key").select("doc_id", "id").distinct(), "minhash-own")
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = components(links)

    # buckets that still hold two components
    placed = materialize(shared.join(roots, "id", "left").select("bucket", "id", "hub", F.coalesce("root", "id").alias("root")), "minhash-placed")
    mixed = materialize(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "minhash-mixed")
    if not mixed.isEmpty():
        # all have been compared with the hub
        apart = materialize(placed.join(mixed, "bucket").where("id <> hub").select("bucket", "id", "root"), "minhash-apart")
        near = _not_unlike(apart, texts, width, percent)
        if not near.isEmpty():
            groups = components(near).withColumnRenamed("root", "g")
            nodes = materialize(apart.select("id", "root").distinct().join(groups, "id"), "minhash-nodes")
            more = _second_look(nodes, texts, width, percent)
            top = components(more).select(F.col("id").alias("root"), F.col("root").alias("top"))
            roots = materialize(roots.unionByName(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(roots.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))), "minhash-roots")
            roots = roots.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    by_class = materialize(classes.select("key", "id").join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("root")), "minhash-by-class")
    out = signed.join(by_class, "key", "left")
    if again:  # and those of its texts that have none
        by_id = own.join(roots, "id").groupBy("doc_id").agg(F.min("root").alias("own_root"))
        out = out.join(by_id, "doc_id", "left").withColumn("root", F.coalesce("root", "own_root"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _packed(nodes: DataFrame, by: str, told: list[str], few: int, many: int, label: str) -> DataFrame:
    """nodes: by, id, root, weight and what is told of them. some, whole: packs that bring all nodes outside a key's
    heaviest root together with all of that key; few and many: the packs' weights, about."""
    per_root = nodes.groupBy(by, "root").agg(F.sum("weight").alias("n"))
    sizes = per_root.groupBy(by).agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"))
    sizes = materialize(sizes.select(by, "main", F.ceil(F.col("n") / many).cast("int").alias("many"), F.ceil((F.col("n") - F.col("most")) / few).cast("int").alias("few")).where("few > 0"), label)
    placed = nodes.join(sizes, by)
    node = F.struct("id", "root", *told)
    pack = F.xxhash64("id")
    whole = placed.groupBy(by, F.pmod(pack, F.col("many")).alias("m")).agg(F.collect_list(node).alias("whole"))
    some = placed.where("root <> main").groupBy(by, F.pmod(pack, F.col("few")).alias("f"), "many").agg(F.collect_list(node).alias("some"))
    some = some.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many").cast("long") - 1))).drop("many")
    return some.join(whole, [by, "m"]).select("some", "whole")


def _not_unlike(apart: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """apart: bucket, id, root. Links a, b that connect all pairs of a bucket, of two roots, whose outlines leave it open whether they are alike."""

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, told = [], []
            for part in parcels(b.column(1)):
                for s in shingle_sets([_raw(t) for t in part], width):
                    sizes.append(len(s))
                    told.append(outline(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(told, pa.binary())], names=["id", "size", "outline"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, up = [], []
            x, y = (_columns(c) for c in b.columns[:2])
            for k in range(b.num_rows):
                x_id, x_root, x_size, x_told = (c[x[0][k] : x[0][k + 1]] for c in x[1:])
                y_id, y_root, y_size, y_told = (c[y[0][k] : y[0][k + 1]] for c in y[1:])
                ids = np.unique(np.concatenate([x_id, y_id]))
                x_at, y_at = np.searchsorted(ids, x_id), np.searchsorted(ids, y_id)
                label = np.arange(len(ids))
                all_y = Outlines(y_size, y_told)
                for i in range(len(x_id)):
                    near = all_y.near(int(x_size[i]), x_told[i], percent)
                    near = near[y_root[near] != x_root[i]]
                    if len(near):
                        met = np.unique(label[np.append(y_at[near], x_at[i])])
                        if len(met) > 1:
                            label[np.isin(label, met)] = met[0]
                moved = np.flatnonzero(label != np.arange(len(ids)))
                a.append(ids[moved])
                up.append(ids[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (a, up)], names=["a", "b"])

    with few_rows_a_batch(apart.sparkSession, 500):
        outlines = texts.mapInArrow(outlined, "id long, size long, outline binary").where("size > 0")
        outlines = materialize(outlines.withColumn("weight", F.length("outline") + 40), "minhash-outlines")
        packs = _packed(apart.join(outlines, "id"), "bucket", ["size", "outline"], FEW_BYTES, MANY_BYTES, "minhash-bucket-sizes")
        return materialize(packs.mapInArrow(connect, "a long, b long").distinct(), "minhash-near")


def _columns(lists: pa.ListArray) -> list:
    """Where each row's nodes begin, and their ids, roots, sizes and outlines."""
    ids, roots, sizes, told = lists.flatten().flatten()
    return [np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), ids.to_numpy(), roots.to_numpy(), sizes.to_numpy(), told.to_pylist()]


def _second_look(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """nodes: id, root, g. Links a, b between roots of the same g that a pair of their nodes proves."""
    told = texts.select(F.col("doc_id").alias("id"), "text", (F.length("text") + 1).alias("weight"))
    packs = _packed(nodes.join(told, "id"), "g", ["text"], FEW, MANY, "minhash-sizes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, whole in zip(b.column(0), b.column(1), strict=True):
                some, whole = some.as_py(), whole.as_py()
                x, y = (shingle_sets([_raw(n["text"]) for n in p], width) for p in (some, whole))
                owner = np.repeat(np.arange(len(y)), [len(s) for s in y])
                size = np.array([len(s) for s in y])
                flat = np.concatenate(y) if y else np.zeros(0, np.uint64)
                order = np.argsort(flat)
                flat, owner = flat[order], owner[order]
                root = np.array([n["root"] for n in whole])
                found = set()
                for s, n in zip(x, some, strict=True):
                    lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum()) if len(s) else np.zeros(0, np.int64)
                    both = np.bincount(owner[at], minlength=len(y))
                    hit = (100 * both >= percent * (len(s) + size - both)) & (both > 0) & (root != n["root"])
                    found.update((n["root"], r) for r in root[hit].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    with few_rows_a_batch(nodes.sparkSession, 4):
        return materialize(packs.mapInArrow(compare, "a long, b long").distinct(), "minhash-more")
