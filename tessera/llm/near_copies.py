"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Links come in two steps, and each link is verified on the sets. First the Golay buckets of ``simhash`` link texts whose
five-word fingerprints lie within two bits: copies with few changes, at the cost of a fingerprint each. Fingerprints
prove no more than that (pairs at 0.8 lie up to 14 of 64 bits apart in the given texts), so the remainder is found exactly:
two sets that similar share a shingle among the first |s| // 5 + 1 of each, in any order of all shingles that both
use. Rare ones come first, so that few texts meet. The order takes the counts of frequent shingles from every sixteenth
text; they change the work, never the result.

Links are transitive: of the texts that file one shingle, that with the fewest rarer ones is compared with every member first,
and then only pairs of different components. Three bounds drop pairs without their texts: the sizes, the shingle's place in both
orders (what two texts share is at most what is left from the first shared one on), and a parity bitmap of about a bit per
shingle, in which the bits that differ are at most the shingles that differ. What is left is compared text by text.

A node is a text: its 64-bit hash, or another number where different texts share a hash (``text_nodes``). Defined results: words are cut and lower-cased as for fingerprints; texts of fewer
than five words are one shingle; null, empty and blank texts are near copies of each other; ties between copies go
to the smaller id (null ids last), then to the smaller hash; a repeated id is judged by each row's own text; an empty
table gives no rows. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, give_back, slices
from .components import connected_components, tasks_for
from .simhash import fingerprint_of, links

SHINGLE, SEED = 5, 42
#: Entries (8 or 16 bytes each) up to which a list is broadcast; longer lists are joined through a shuffle.
BROADCAST_NODES = 500_000
#: One text in so many is counted for the order; frequent is a shingle in ``OFTEN`` of these; so many frequent ones are ordered.
SAMPLE, OFTEN, ORDERED = 16, 4, 100_000
#: Texts that may share the 64-bit hash of another (about n * n / 2^65 of n do).
MOST_CLASHES = 10_000
#: Bits of a bitmap: a power of two, at least and at most.
LEAST_BITS, MOST_BITS = 64, 1 << 15


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending, as signed integers; at least one."""
    import xxhash

    words, digest = (text or "").encode().lower().split(), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def bitmap(hashes: np.ndarray) -> bytes:
    """The parity of the shingles on each bit; about a bit per shingle."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()))
    ones = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(one: bytes, two: bytes) -> int:
    """Bits that differ. The longer bitmap is folded to the length of the other: parities add up."""
    x, y = sorted((int.from_bytes(one, "little"), int.from_bytes(two, "little"))) if len(one) == len(two) else (int.from_bytes(b, "little") for b in sorted((one, two), key=len))
    size, bits = 8 * min(len(one), len(two)), 8 * max(len(one), len(two))
    while bits > size:
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(_text(text_col))


def text_nodes(docs: DataFrame, text_col: str) -> Column:
    """A number for each different text: its 64-bit hash, or another where two texts have one hash (some of 10^10 do).

    Hashes with several SHA-256 digests are looked for over all documents; all their texts but one are numbered by their digest instead.
    """
    renamed: dict[str, int] = {}
    node = text_hash(text_col)
    for turn in range(1, 64):
        each = docs.select(node.alias("node"), F.sha2(_text(text_col), 256).alias("digest"))
        shared = each.groupBy("node").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most")
        clashing = each.join(shared, "node").where("digest <> least").select("digest").distinct().limit(MOST_CLASHES + 1).collect()
        if not clashing:
            return node
        renamed |= {r["digest"]: turn for r in clashing}
        if len(renamed) > MOST_CLASHES:
            raise ValueError("too many texts share a 64-bit hash")
        digest, other = F.sha2(_text(text_col), 256), text_hash(text_col)
        for t in range(1, turn + 1):
            other = F.when(digest.isin([d for d, at in renamed.items() if at == t]), F.xxhash64(F.lit(t), digest)).otherwise(other)
        node = other
    raise ValueError("texts can't be told apart")


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of frequent shingles, ascending, and their places in the order, from a sample of the texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in batch.column(0).to_pylist()]))], ["hash"])

    counts = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("text").mapInArrow(emit, "hash long").groupBy("hash").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "hash").limit(ORDERED).collect()
    hashes = np.array([r["hash"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], (len(rows) - np.arange(len(rows)))[order]


def prefixes(texts: DataFrame) -> DataFrame:
    """(node, size, fp, bits, prefix): one row per distinct text of (node, text)."""
    texts = texts.select("node", "text")
    often, rank = frequent(texts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, fps, maps, firsts = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text)
                places = np.zeros(len(hashes), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                    places = np.where(often[at] == hashes, rank[at], 0)
                sizes.append(len(hashes))
                fps.append(fingerprint_of(hashes.view(np.uint64)))
                maps.append(bitmap(hashes))
                firsts.append(hashes[np.lexsort((hashes, places))[: len(hashes) // 5 + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(maps, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], ["node", "size", "fp", "bits", "prefix"])
        give_back()

    rows = texts.mapInArrow(emit, "node long, size int, fp long, bits binary, prefix array<long>")
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in rows.columns[1:]))


def _short(df: DataFrame) -> DataFrame:
    """The rows, written once and read in as many tasks as their number asks for."""
    df = checkpointed(df)
    return df.coalesce(tasks_for(df.count()))


def _bounded(df: DataFrame) -> DataFrame:
    """The (checkpointed) list, to be broadcast where its length is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps leave room for 9 * |differing shingles| <= |a| + |b|."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_bits, b_bits, a_size, b_size = (batch.column(i).to_pylist() for i in range(2, 6))
            room = [9 * bits_apart(x, y) <= m + n for x, y, m, n in zip(a_bits, b_bits, a_size, b_size, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(room, pa.bool_()))

    x, y = (nodes.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("bits").alias(f"{n}_bits")) for n in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "a_bits", "b_bits", "a_size", "b_size").mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The text of b goes to that of a."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_a = None, np.zeros(0, np.int64)
        for batch in slices(batches, 64):
            a, b, a_text, b_text = (c.to_pylist() for c in batch.columns)
            near = []
            for node, one, two in zip(a, a_text, b_text, strict=True):
                if node != known:
                    known, of_a = node, shingles(one)
                of_b = shingles(two)
                near.append(9 * len(np.intersect1d(of_a, of_b, assume_unique=True)) >= 4 * (len(of_a) + len(of_b)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([v for v, ok in zip(side, near, strict=True) if ok] for side in (a, b))], ["a", "b"])

    pairs = _short(pairs)
    firsts = _short(pairs.select("a").distinct())
    ours = texts.join(_bounded(firsts.withColumnRenamed("a", "node")), "node", "left_semi").select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    theirs = texts.join(_bounded(pairs.withColumnRenamed("b", "node")), "node").select("a", F.col("node").alias("b"), F.col("text").alias("b_text"))
    return _short(theirs.join(ours, "a").select("a", "b", "a_text", "b_text").mapInArrow(keep, "a long, b long").distinct())


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_node: Column | None = None) -> DataFrame:
    """(node, root) for every distinct text that is a near copy of another; root is the least node of its component. text_node: as ``text_nodes`` gave it."""
    text_node = text_nodes(docs, text_col) if text_node is None else text_node
    rows = docs.select(F.col(id_col).alias("id"), text_node.alias("node"), F.col(text_col).cast("string").alias("text"))
    nodes = checkpointed(prefixes(rows))
    # one row stands for all of its text, but for rows that repeat whole
    copied = checkpointed(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1 and first is not null").select(F.col("node").alias("copied"), "first"))
    texts = rows.join(_bounded(copied), F.col("node") == F.col("copied"), "left").where("copied is null or id = first").select("node", "text")
    # texts of close fingerprints
    stood = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    close = links(stood).join(stood.withColumnsRenamed({"fp": "a", "first": "x"}), "a").join(stood.withColumnsRenamed({"fp": "b", "first": "y"}), "b").select(*_ordered(F.col("x"), F.col("y")))
    same = nodes.join(stood, "fp").where("node <> first").select(*_ordered(F.col("first"), F.col("node")))
    edges = verified(possible(close.union(same).distinct(), nodes), texts)
    # texts that file a shingle together
    filed = nodes.select("node", "size", F.posexplode("prefix").alias("place", "token"))
    shared = filed.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    busy = checkpointed(filed.join(shared, "token"))
    stars = _short(possible(_met(busy, None, busy.groupBy("token").agg(F.min(F.struct("place", "node"))["node"].alias("node"))), nodes))
    edges = edges.union(verified(stars, texts))
    groups = _groups(edges)
    rest = _short(possible(_met(busy, groups).join(stars, ["a", "b"], "left_anti"), nodes))
    return groups if rest.isEmpty() else _groups(groups.where("node <> root").union(verified(rest, texts).toDF("node", "root")).toDF("a", "b"))


def _met(busy: DataFrame, groups: DataFrame | None, leaders: DataFrame | None = None) -> DataFrame:
    """The pairs that file a shingle together, belong to different components (without groups, of any) and have near sizes; with leaders, only pairs of one."""
    rooted = busy.withColumn("root", F.col("node")) if groups is None else busy.join(_bounded(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted if leaders is None else rooted.join(leaders, ["token", "node"], "left_semi")
    near = (5 * F.col("x.size") >= 4 * F.col("y.size")) & (5 * F.col("y.size") >= 4 * F.col("x.size"))
    # at the first shingle that two texts share, what they share is at most what is left of either from there on
    left = 9 * F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= 4 * (F.col("x.size") + F.col("y.size"))
    apart = F.col("x.node") < F.col("y.node") if leaders is None else F.col("x.node") != F.col("y.node")
    joined = first.alias("x").join(rooted.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & (F.col("x.root") != F.col("y.root")) & near & left)
    return joined.select(*_ordered(F.col("x.node"), F.col("y.node"))).distinct()


def _groups(edges: DataFrame) -> DataFrame:
    """The components of the edges, with each root itself as a row."""
    linked = connected_components(edges)
    return _short(linked.union(linked.select("root", "root")).distinct())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: that of the smallest id (null ids last), then of the smallest text hash.

    Every row is judged by its own text. Only ids and hashes are joined; texts move only where more rows go than
    ``BROADCAST_NODES``, or where whole rows repeat.
    """
    node, text_node = fresh_name(docs, "node"), text_nodes(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_node.alias("node"))
    found = checkpointed(rows.groupBy("id", "node").agg(F.count("*").alias("n")).join(copy_groups(docs, id_col, text_col, text_node), "node", "left").select("id", "node", "n", F.coalesce("root", "node").alias("root")))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    losers = checkpointed(found.join(first, "root").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node")))).select(F.col("id").alias("lost_id"), F.col("node").alias("lost_node")))
    marked = docs.withColumn(node, text_node)
    kept = marked.join(_bounded(losers), F.col(f"`{id_col}`").eqNullSafe(F.col("lost_id")) & (F.col(node) == F.col("lost_node")), "left_anti")
    if not found.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, node])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
