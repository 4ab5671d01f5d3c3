"""Exact n-gram Jaccard join of documents by count vectors in R-trees.

A document is the set of its distinct word shingles (64-bit hashes). Two
documents link when 100 * |A n B| >= percent * |A u B|.

Points. Shingles are hashed into groups, about ``FILL`` to a group, so that long
documents have longer vectors; a document's group counts are its point, and the
points of a tree are folded to the fewest groups among them. The sum of
coordinate minima of two points bounds the overlap of the two sets from above,
and the same sum over the corner of a box bounds that of a point with every
point in the box. So an R-tree gives all partners that the bound allows, best
first, and these are verified on the sets.

Distribution. Linked sets differ in few shingles: at most D, by their sizes.
Sets are dealt by size into bands, and in a band into D + 2 + E parts by shingle
hash; two linked sets agree in at least 2 + E parts. E is chosen so that hardly
a document has 2 + E empty parts; those that have deal their empty parts too,
all others only parts that hold something. So linked documents share a part's
contents (a block). Only parts seen in two documents or more leave their task
(a count-min sketch tells, never below the true count). A block belongs to its
smallest document, and all documents that share a block of one owner are that
owner's group: a document is in a group once, however many parts it shares.

A group is cut into tiles of bounded size, each with the owner in it. A first
pass queries the R-tree of each tile and keeps the documents that have a
candidate; only their sets travel, once a tile. The second pass asks the tree
again, verifies candidates best first and passes over those that verified links
already join, so a group of k copies takes about k comparisons, not k squared.
Members of many-tiled groups that this leaves apart from their owner meet the
group's other tiles in the same way. The links' connected components follow.
Documents with equal sets are one node from the start.

Defined results: null and empty texts, and texts without words, have no
shingles and link with nothing; fewer words than a shingle make one shingle of
the whole; very long texts have long vectors and tiles of their own; each row is
a document of its own, also where a doc_id repeats; a null doc_id counts as
smaller than any and comes back as null; ties do not matter, since links have no
order; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.components import components
from gaugeworks.llm.repeats import build_filter, repeated
from gaugeworks.llm.runtime import bound_batches, materialise, release, strings, sweep, table, text_of, without_rows
from gaugeworks.llm.shingles import hasher, lower_ascii, mix, words_of

WORDS, PERCENT = 3, 90
#: Shingles of a group at most, on average, and bounds of the number of groups (as powers of two).
FILL, LEAST_BITS, MOST_BITS = 4, 4, 20
#: Ratio of a size band's ends; documents and shingles of a tile; points of a leaf.
BAND, TILE, TILE_SHINGLES, LEAF = 1.5, 512, 1 << 19, 16
#: Rows and shingles of the tiles that share a Python group.
GROUP_ROWS, GROUP_SHINGLES = 4000, 1 << 21
CALL = 64
_NULL_ID = -(1 << 63)


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document given by its word hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(words, len(hashes))
    return np.unique(mix(hasher().rolling(hashes, width, 0) + np.uint64(width)))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    return [shingle_set(h, words) for h in hasher().hashes([words_of(lower_ascii(t)) for t in texts])]


def band_ends(largest: int) -> list[int]:
    """Last sizes of the bands that cover 1 to ``largest``."""
    ends, last = [], 0
    while last < largest:
        last = max(last + 1, int((last + 1) * BAND))
        ends.append(last)
    return ends


_ENDS = np.array(band_ends(1 << 40), np.int64)


@cache
def parts_of(band: int, percent: int) -> tuple[int, int]:
    """A band's number of parts, and how many of them two linked sets agree in at least."""
    end, least = int(_ENDS[band]), int(_ENDS[band - 1]) + 1 if band else 1
    differ = 2 * end * (100 - percent) // (100 + percent)
    extra = 0
    for _ in range(4):  # empty parts of the band's smallest sets: mean and four deviations
        mean = (differ + 2 + extra) * math.exp(-least / (differ + 2 + extra))
        extra = min(int(mean + 4 * math.sqrt(mean)), differ)
    return differ + 2 + extra, 2 + extra


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the document's parts, for its own band and for those where a larger partner may lie."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    own, last = (int(np.searchsorted(_ENDS, m)) for m in (n, max(n, n * 100 // percent)))
    out = []
    for band in range(own, last + 1):
        parts, agree = parts_of(band, percent)
        part = ((shingles >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)
        # Sixteen bits sort by counting.
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        sorted_part = part[order]
        begin = np.r_[0, np.flatnonzero(np.diff(sorted_part)) + 1]
        content = np.add.reduceat(mix(shingles[order] ^ np.uint64(0xA0761D6478BD642F)), begin)
        present = sorted_part[begin]
        if parts - len(present) >= agree:
            absent = np.setdiff1d(np.arange(parts, dtype=np.uint64), present)
            present, content = np.r_[present, absent], np.r_[content, np.zeros(len(absent), np.uint64)]
        out.append(mix(content + mix(present + (np.uint64(band) << np.uint64(40)))))
    return np.unique(np.concatenate(out))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall in each group, a byte each; empty (no bound) should a count not fit."""
    bits = min(MOST_BITS, max(LEAST_BITS, (max(1, len(shingles)) // FILL).bit_length()))
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8) if counts.max() < 256 else np.zeros(0, np.uint8)


def folded(vectors: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Count vectors as points of one length: that of the shortest. No vector: a point that bounds nothing."""
    width = min((len(v) for v in vectors if len(v)), default=1)
    out = np.empty((len(vectors), width), np.int32)
    for k, v in enumerate(vectors):
        out[k] = v.reshape(width, -1).sum(1, dtype=np.int32) if len(v) else sizes[k]
    return out


class RTree:
    """A bulk-loaded two-level R-tree over count vectors.

    Points are sorted by size and then by their heaviest spread coordinates and
    cut into leaves; a leaf keeps the largest coordinates and smallest size of
    its points, enough to bound every overlap with them.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        if len(points) > LEAF:
            spread = np.argsort(-points.var(0), kind="stable")[:2]
            order = np.lexsort((points[:, spread[-1]], points[:, spread[0]], sizes))
        else:
            order = np.arange(len(points))
        self.order, self.points, self.sizes, self.percent = order, points[order], sizes[order].astype(np.int64), percent
        begin = np.arange(0, len(order), LEAF)
        self.begin = np.r_[begin, len(order)]
        self.top = np.maximum.reduceat(self.points, begin)
        self.least = np.minimum.reduceat(self.sizes, begin)

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Indices of all points whose bound with this one allows a link, the largest share first."""
        p = self.percent
        fits = (100 + p) * np.minimum(self.top, point).sum(1, dtype=np.int64) >= p * (self.least + size)
        leaves = np.flatnonzero(fits)
        if not len(leaves):
            return leaves
        at = np.concatenate([np.arange(self.begin[k], self.begin[k + 1]) for k in leaves]) if len(leaves) < len(fits) else np.arange(len(self.order))
        bound = np.minimum(self.points[at], point).sum(1, dtype=np.int64)
        good = np.flatnonzero((100 + p) * bound >= p * (self.sizes[at] + size))
        share = bound[good] / (self.sizes[at[good]] + size)
        return self.order[at[good[np.argsort(-share, kind="stable")]]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return (100 + percent) * int((b[at] == a).sum()) >= percent * (len(a) + len(b))


def tile_links(sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (as indices) that join all that a tile's links join and its labels do not.

    Where no row asks, all are compared with all; otherwise those that ask with the others.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    points = folded([count_vector(s) for s in sets], sizes)
    held = np.flatnonzero(~asks) if asks.any() else np.arange(len(sets))
    tree = RTree(points[held], sizes[held], percent)
    label, out = labels.copy(), []
    for q in np.flatnonzero(asks) if asks.any() else held:
        hits = held[tree.query(points[q], int(sizes[q]))]
        hits = hits[label[hits] != label[q]]
        while len(hits):
            if linked(sets[q], sets[hits[0]], percent):
                out.append((int(q), int(hits[0])))
                label[label == label[hits[0]]] = label[q]
                hits = hits[label[hits] != label[q]]
            else:
                hits = hits[1:]
    return out


def _number() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))


def _each_tile(tiles: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(tiles, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1)


def _lists(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """The arrays of an Arrow list or binary column."""
    out = []
    for chunk in column.chunks:
        if pa.types.is_list(chunk.type):
            flat, ends = chunk.flatten().to_numpy().view(dtype), chunk.offsets.to_numpy()
            ends = ends - ends[0]
            out += [flat[b:e] for b, e in zip(ends[:-1], ends[1:], strict=True)]
        else:
            out += [np.frombuffer(b, dtype) for b in chunk.to_pylist()]
    return out


def _dealt(rows: int, shingles: int) -> Column:
    """The Python group that a tile goes to: many small tiles share one."""
    return F.pmod(F.xxhash64("tile"), F.lit(1 + max(rows // GROUP_ROWS, shingles // GROUP_SHINGLES))).alias("g")


def _links_of(placed: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (u, v) among the rows of each tile of ``placed`` (tile, id, n, vec, label, asks)."""
    rows, shingles = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def candidates(group: pa.Table) -> pa.Table:
        tile, ids, sizes, labels, asks = (group.column(c).to_numpy() for c in ("tile", "id", "n", "label", "asks"))
        vectors = _lists(group.column("vec"), np.uint8)
        keep = []
        for at in _each_tile(tile):
            points = folded([vectors[k] for k in at], sizes[at])
            asking = np.flatnonzero(asks[at])
            held = np.flatnonzero(~asks[at]) if len(asking) else np.arange(len(at))
            if not len(held) or len(at) < 2:
                continue
            tree, met = RTree(points[held], sizes[at][held], percent), np.zeros(len(at), bool)
            for q in asking if len(asking) else held:
                hits = held[tree.query(points[q], int(sizes[at[q]]))]
                hits = hits[labels[at[hits]] != labels[at[q]]]
                if len(hits):
                    met[hits] = met[q] = True
            keep.append(at[met])
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        return group.select(["tile", "id", "n", "label", "asks"]).take(pa.array(keep))

    wanted = materialise(placed.withColumn("g", _dealt(rows, shingles)).groupBy("g").applyInArrow(candidates, "tile long, id long, n long, label long, asks boolean"))
    rows, shingles = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def verify(group: pa.Table) -> pa.Table:
        tile, ids, labels, asks = (group.column(c).to_numpy() for c in ("tile", "id", "label", "asks"))
        found = _lists(group.column("shingles"), np.uint64)
        pairs = []
        for at in _each_tile(tile):
            # A row of documents that stands there more than once gives its set as often.
            at = at[np.unique(np.stack([ids[at], asks[at]]), axis=1, return_index=True)[1]]
            pairs += [(ids[at[i]], ids[at[j]]) for i, j in tile_links([found[k] for k in at], labels[at], asks[at], percent)]
        u, v = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    with_sets = sets(wanted.drop("n"))
    out = materialise(with_sets.withColumn("g", _dealt(rows, shingles)).groupBy("g").applyInArrow(verify, "u long, v long"))
    release(placed)
    release(wanted)
    sweep(placed.sparkSession)
    return out


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id (null as the smallest number), hash of the text, n, a, b (which identify the set), and the
    component's smallest doc_id and, for that, text hash (``first``) of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(_number().alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def keys_of(texts: list[str]) -> Iterator[np.ndarray]:
        for s in shingle_sets(texts, words):
            yield signatures(s, percent)

    # A part holds about (100 + p) / 2 (100 - p) shingles; six characters a word, and room for second bands.
    expected = int(chars / 6 * 2 * (100 - percent) / (100 + percent) * 1.8)
    sent = spark.sparkContext.broadcast(build_filter(rows.select("text"), keys_of, expected))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, filters = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, CALL):
                part = batch.slice(at, CALL)
                n, a, b, vec, blocks = [], [], [], [], []
                for s in shingle_sets(strings(part.column(1)), words):
                    keys = signatures(s, percent)
                    keys = keys[repeated(keys, size, filters)] if len(keys) else keys
                    n.append(len(s))
                    a.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    b.append(int(mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    vec.append(count_vector(s).tobytes() if len(keys) else b"")
                    blocks.append(keys.view(np.int64))
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(vec, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))],
                    ["doc_id", "h", "n", "a", "b", "vec", "blocks"],
                )

    described = rows.mapInArrow(describe, "doc_id long, h long, n long, a long, b long, vec binary, blocks array<long>")
    base = materialise(described.withColumn("row", F.monotonically_increasing_id()))
    # A node is a distinct set, numbered by one of its rows; the numbers are frozen in the table.
    equal = materialise(base.where("n > 0").groupBy("n", "a", "b").agg(F.min("row").alias("id"), F.count("*").alias("copies")))
    nodes = base.where("size(blocks) > 0").withColumnRenamed("row", "id").join(equal.select("id"), "id", "left_semi")
    light = nodes.select("id", "n", "vec")
    blocks = nodes.select(F.explode("blocks").alias("block"), "id")
    owners = blocks.groupBy("block").agg(F.min("id").alias("pivot"), F.count("*").alias("held")).where("held > 1").drop("held")
    members = materialise(blocks.join(owners, "block").select("pivot", "id").distinct())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CALL):
                part = batch.slice(at, CALL)
                # Rows of one document, one for each of its tiles, follow each other.
                ids = part.column(1).to_numpy()
                first = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
                got = shingle_sets(strings(part.column(4).take(pa.array(first))), words)
                which = np.cumsum(np.r_[0, np.diff(ids) != 0])
                yield pa.record_batch([*part.columns[:4], pa.array([got[k].view(np.int64) for k in which], pa.list_(pa.int64()))], [*part.schema.names[:4], "shingles"])

    def sets(wanted: DataFrame, few: bool = False) -> DataFrame:
        """Rows (tile, id, label, asks) with the node's set, made again from its text, which moves once.

        Where they should be ``few``, Spark may broadcast them, if their table is small enough for that.
        """
        source = materialise(nodes.select("id", "doc_id", "h").join(wanted, "id"))
        texts = rows.join(source if few else source.hint("merge"), ["doc_id", "h"]).select("tile", "id", "label", "asks", "text")
        return texts.mapInArrow(gather, "tile long, id long, label long, asks boolean, shingles array<long>")

    sized = members.join(light, "id")
    large = sized.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")).where("tiles > 1")
    large = materialise(large)
    spot = F.pmod(F.xxhash64("id"), "tiles").cast("int")
    tiled = sized.join(large, "pivot", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    in_tiles = F.explode(F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(spot)))
    placed = tiled.select("pivot", "id", "n", "vec", in_tiles.alias("t")).select(F.xxhash64("pivot", "t").alias("tile"), "id", "n", "vec", F.col("id").alias("label"), F.lit(False).alias("asks"))
    links = _links_of(materialise(placed), sets, percent)
    settled = materialise(components(links))
    if large.head(1):
        apart = _apart(members.join(large, "pivot"), settled, light)
        more = _links_of(materialise(apart), partial(sets, few=True), percent)
        links = materialise(links.unionByName(more))
        settled = materialise(components(links))
    # Most sets have neither copies nor links; the rows of the others meet by class.
    classed = equal.join(settled.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or label is not null").select("n", "a", "b", F.coalesce("label", "id").alias("label"))
    firsts = base.select("doc_id", "h", "n", "a", "b").join(classed, ["n", "a", "b"]).groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    of_set = materialise(classed.join(firsts, "label").select("n", "a", "b", "first"))
    for done in (members, equal, large, links, settled):
        release(done)
    sweep(spark)
    return base.select("doc_id", "h", "n", "a", "b").join(of_set, ["n", "a", "b"], "left").withColumn("first", F.coalesce("first", F.struct("doc_id", "h")))


def _apart(members: DataFrame, settled: DataFrame, light: DataFrame) -> DataFrame:
    """Tiles in which the members of many-tiled groups (pivot, id, tiles) that are not linked to the
    owner meet all of the group. A member that asks goes to every tile of the group; a tile of those
    that ask and a tile of the group make one."""
    label = F.coalesce("label", "id").alias("label")
    named = members.join(settled.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", "tiles", label)
    named = named.join(settled.toDF("pivot", "pivot_label"), "pivot", "left").withColumn("open", F.col("label") != F.coalesce("pivot_label", "pivot"))
    asking = materialise(named.where("open").select("pivot", "id", "tiles", "label"))
    counts = asking.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("open_tiles"))
    spot = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    ask = asking.join(counts, "pivot").select("pivot", "id", "label", spot("open_tiles").alias("s"), every("tiles").alias("t"), F.lit(True).alias("asks"))
    held = named.join(counts, "pivot").select("pivot", "id", "label", every("open_tiles").alias("s"), spot("tiles").alias("t"), F.lit(False).alias("asks"))
    return ask.unionByName(held).join(light, "id").select(F.xxhash64("pivot", "s", "t").alias("tile"), "id", "n", "vec", "label", "asks")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    back = lambda c: F.when(c != _NULL_ID, c)
    found = classes(docs, words, percent)
    return found.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("first.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; columns as they were.

    Rows are told apart by doc_id and text, so a row that shares only its doc_id
    with a near copy stays. Of rows equal in both, all but one go. Rows without
    words stay, whatever else there is.
    """
    found = classes(docs, words, percent).where("n > 0")
    gone = found.where("not (doc_id = first.doc_id and h = first.h)").select("doc_id", "h").distinct()
    tied = found.where("doc_id = first.doc_id and h = first.h").groupBy("doc_id", "h").count().where("count > 1").drop("count")
    return without_rows(docs, [_number(), F.xxhash64(text_of())], gone, tied)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), by comparing every pair; for tests on small tables."""
    sets = {}
    for doc_id, text in rows:
        found = words_of(lower_ascii(text or ""))
        sets[doc_id] = {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    for a, x in enumerate(ids):
        for y in ids[a + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = {d: low if v == high else v for d, v in label.items()}
    return {d: (len(sets[d]), label[d]) for d in ids}
