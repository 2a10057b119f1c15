"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprints (64 bits over 3-word shingles) link at two or fewer differing bits. A fingerprint is cut into three
segments of 23, 23 and 18 bits. By the pigeonhole principle two linked fingerprints agree wholly in one segment and
differ in at most one bit in the next one (in the order 1, 2, 3, 1), whichever way two errors fall. The second of the
two is hashed fuzzily: the perfect binary Golay code (23, 12, 7) decodes every 23-bit word to the one codeword
within three bits; a word within one bit of it has that codeword within four bits. So each fingerprint is filed
under the indices of all codewords within four bits of its segment (one or six), its decoded one marked as own; two
linked fingerprints share a bucket in which one of them is own. Candidates are verified by counting bits.

Groups never turn into all pairs: equal fingerprints are one node, and buckets of more than ``bucket`` nodes are
resolved exactly by another way, in which each member is filed under the 65 words within one bit of it. Two words
are within two bits if and only if they share such a word, and no such word has more than 65 members.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of one or two words are one
shingle. Rows with a null id are fingerprinted and belong to components, but never name one (a component of such
rows only has a null id). Repeated rows repeat. Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns
from .components import connected_components

SHINGLE, SEED = 3, 42
#: Nodes that one bucket may compare with each other; larger buckets take the exact way by one-bit neighbours.
BUCKET = 128
_AT_ONCE = 1 << 15
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned. ``bytes.split`` cuts at exactly \\x20 and \\x09-\\x0D."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    total, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, total))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned hashes."""
    ones, total = np.zeros(64, np.int64), len(hashes)
    for at in range(0, total, _AT_ONCE):
        part = hashes[at : at + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def remainder(word: int) -> int:
    """Of a 23-bit word's polynomial by the generator: the syndrome."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes' values; by syndrome, up to six error words to codewords within four bits; their number."""
    by_byte = np.array([[remainder(value << shift & 0x7FFFFF) for value in range(256)] for shift in (0, 8, 16)], np.uint32)
    of_bit = [remainder(1 << i) for i in range(23)]
    errors: dict[int, list[int]] = defaultdict(list)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome, word = 0, 0
            for b in bits:
                syndrome, word = syndrome ^ of_bit[b], word | 1 << b
            errors[syndrome].append(word)
    table, number = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for syndrome, words in errors.items():
        table[syndrome, : len(words)], number[syndrome] = words, len(words)
    return by_byte, table, number


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six codeword indices (12 bits), the decoded one first, and how many of the six count."""
    by_byte, table, number = golay_tables()
    syndrome = by_byte[0][words & 0xFF] ^ by_byte[1][words >> 8 & 0xFF] ^ by_byte[2][words >> 16 & 0xFF]
    return (words[:, None] ^ table[syndrome]) >> 11, number[syndrome]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of the fingerprint, own) of every bucket that the fingerprints belong to."""
    segments = [(fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.uint32) for low, bits in SEGMENTS]
    keys, places, owns = [], [], []
    for k in range(3):
        exact, (near, number) = segments[k].astype(np.int64), near_codewords(segments[(k + 1) % 3])
        counts = np.arange(6)[None, :] < number[:, None]
        key = (np.int64(k) << 35) | (exact[:, None] << 12) | near.astype(np.int64)
        keys.append(key[counts])
        places.append(np.nonzero(counts)[0])
        owns.append(np.broadcast_to(np.arange(6) == 0, counts.shape)[counts])
    return np.concatenate(keys), np.concatenate(places), np.concatenate(owns)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key, place, own = bucket_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[place]), pa.array(own)], ["key", "fp", "own"])


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges whose components are those of all links between the distinct fingerprints ``nodes(fp)``."""
    keys = nodes.select("fp").mapInArrow(_keys, "key long, fp long, own boolean")
    shared = checkpointed(keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("owns")).where("n > 1 and owns > 0").select("key", "n"))
    busy = checkpointed(keys.join(shared, "key"))
    small = busy.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"), F.collect_list("fp").alias("any"))
    pairs = small.select(F.explode("own").alias("a"), "any").select("a", F.explode(F.filter("any", lambda b: (b != F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= 2))).alias("b"))
    crowded = busy.where(F.col("n") > bucket).select("fp").distinct()
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = crowded.select("fp", F.explode(ball).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return pairs.union(stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id) for every row; fp is the fingerprint as a signed long."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    rows = checkpointed(map_columns(slim, ["text"], [("fp", "long", pa.int64())], start, drop=("text",)))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = checkpointed(connected_components(links(nodes, bucket)).select(F.col("node").alias("fp"), "root").join(nodes, "fp").select("fp", "root", "first"))
    if roots.isEmpty():
        classes = nodes.select("fp", F.col("first").alias("component_id"))
    else:
        # a component's least node is its root, which itself has no row among the nodes below it
        lowest = roots.select("root", "first").union(roots.select("root").distinct().join(nodes.withColumnRenamed("fp", "root"), "root")).groupBy("root").agg(F.min("first").alias("component_id"))
        linked = roots.select("fp", "root").union(lowest.select(F.col("root").alias("fp"), "root")).join(lowest, "root").select("fp", "component_id")
        classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(checkpointed(classes), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op4_golay_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
