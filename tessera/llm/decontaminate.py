"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document is searched for whole occurrences of windows (containment 1 over item-sized windows).

The join's parts: the five-word shingles of every window (all words of a shorter one) are ordered by rarity, counted over all
documents. Containment of the whole window makes its first shingle in that order the necessary prefix. Documents' occurrences of such prefixes, each with the
words around it, are joined with the windows by the prefix; the positional bound follows from the prefix's place in the window, the
length bound from the words left before and after it; what remains is verified word by word.

Windows, shingles, counts and prefixes are tables and are joined by Spark, whatever the benchmark's size. Documents are read twice: to count, and to find. Both times a bitmap of at most
``filter_bytes`` tells most other shingles apart before anything is written; what it lets through by chance the joins drop, so its size
changes the work, never the result. A text that recurs is joined once, by 120 bits of its SHA-256.

Defined results: null or empty texts have no words (n_hit 0, not contaminated); an item without words is no
window; repeated rows give repeated results; a benchmark table without rows contaminates nothing; null item ids
count as the empty string; ties in rarity go to the smaller hash, then to the first place; an empty table gives no rows;
columns other than those named are not read, a new column whose name is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, checkpointed, fresh_name, give_back, map_columns, slices, text_key

WINDOW, SHINGLE = 13, 5
#: Bytes of a bitmap of shingles, at most; and its bits per shingle.
FILTER_BYTES, BITS_EACH = 16 << 20, 64
#: Words whose hashes a task remembers.
_REMEMBERED = 200_000
#: Bits of the bitmap that one group makes.
_CHUNK_BITS = 1 << 18
_EVEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers


def hasher() -> Callable[[list[bytes]], np.ndarray]:
    """A function from words to their 64-bit hashes that remembers the words it has seen."""
    import xxhash

    known: dict[bytes, int] = {}

    def hashes(words: list[bytes]) -> np.ndarray:
        if len(known) > _REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return hashes


def tokens(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each place at which ``width`` words stand."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _EVEN + hashes[i : i + n]
        out ^= out >> np.uint64(29)
    out *= _ODD
    return out ^ (out >> np.uint64(32))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, size, tokens, items): each different window of items(item, text), its shingles' hashes in order, and the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            owners, windows = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = ascii_lower_words(text)
                mine = {b" ".join(words[at : at + size]) for at in range(max(1, len(words) - size + 1) if words else 0)}
                windows += [w.decode() for w in mine]
                owners += [item] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    def start():
        hashes = hasher()

        def work(windows):
            cut = [w.encode().split(b" ") for w in windows]
            return [[len(w) for w in cut], [_signed(tokens(hashes(w), min(SHINGLE, len(w)))).tolist() for w in cut]]

        return work

    different = items.select("item", "text").mapInArrow(cut, "item string, window string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return map_columns(different, ["window"], [("size", "int", pa.int32()), ("tokens", "array<long>", pa.list_(pa.int64()))], start)


def bitmap(found: DataFrame, filter_bytes: int) -> np.ndarray:
    """Bits for the numbers of found(token), two each; made chunk by chunk, so that at most ``filter_bytes`` come together."""
    n = found.count()
    bits = 1 << max(6, min((n * BITS_EACH).bit_length(), (8 * filter_bytes).bit_length() - 1))
    places = found.select(F.explode(F.array(F.col("token").bitwiseAND(bits - 1), F.shiftrightunsigned("token", 32).bitwiseAND(bits - 1))).alias("bit")).distinct()

    def chunk(rows: pa.Table) -> pa.Table:
        at = rows["bit"].to_numpy()
        ones = np.zeros(min(bits, _CHUNK_BITS), np.uint8)
        ones[at % _CHUNK_BITS] = 1
        return pa.table({"chunk": pa.array([int(at[0]) // _CHUNK_BITS], pa.int64()), "bytes": pa.array([np.packbits(ones, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in places.groupBy((F.col("bit") / _CHUNK_BITS).cast("long").alias("chunk")).applyInArrow(chunk, "chunk long, bytes binary").collect():
        out[r["chunk"] * _CHUNK_BITS // 8 :][: len(r["bytes"])] = np.frombuffer(r["bytes"], np.uint8)
    return out


def may_hold(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of ``x`` whose two bits are both set."""
    mask = np.uint64(8 * len(bits) - 1)

    def is_set(at: np.ndarray) -> np.ndarray:
        return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1

    first = np.flatnonzero(is_set(x & mask))
    return first[is_set((x[first] >> np.uint64(32)) & mask) == 1]


def corpus_counts(texts: DataFrame, widths: list[int], bits: np.ndarray) -> DataFrame:
    """(token, n): how often shingles that the bitmap may hold occur in texts(text), pre-aggregated by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hasher()
        for batch in slices(batches, 1024):
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                own = hashes(ascii_lower_words(text))
                for width in widths:
                    t = tokens(own, width)
                    found.append(t[may_hold(bits, t)])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(token)), pa.array(n.astype(np.int64))], ["token", "n"])
        give_back()

    return texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefix_table(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, at, window, size, items): the rarest shingle of each window. A window with an unseen shingle can't occur."""
    each = windows.select("window", F.posexplode("tokens").alias("at", "token")).join(counts, "token", "left")
    rarest = each.groupBy("window").agg(F.count("n").alias("seen"), F.count("*").alias("all"), F.min(F.struct("n", "token", "at")).alias("m")).where("seen = all")
    return rarest.select("window", "m.token", "m.at").join(windows.select("window", "size", "items"), "window")


_CANDIDATES = "array<struct<place:int,token:long,before:int,context:string>>"
_CANDIDATE = pa.list_(pa.struct([("place", pa.int32()), ("token", pa.int64()), ("before", pa.int32()), ("context", pa.string())]))


def _searcher(widths: list[int], bits: np.ndarray, window: int) -> Callable[[], Callable]:
    """Texts to their numbers of words and their occurrences of prefixes: the place, the words around it, and how many of these stand before it."""

    def start():
        hashes = hasher()

        def work(texts):
            counts, found = [], []
            for text in texts:
                words = ascii_lower_words(text)
                own, mine = hashes(words), []
                for width in widths:
                    t = tokens(own, width)
                    for place in may_hold(bits, t).tolist():
                        begin = max(0, place - window + width)
                        mine.append({"place": place, "token": int(t[place].view(np.int64)), "before": place - begin, "context": b" ".join(words[begin : place + window]).decode()})
                counts.append(len(words))
                found.append(mine)
            return [counts, found]

        return work

    return start


def _verified(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key_a, key_b, all_spans, items) of texts with hits, from (key_a, key_b, n_words, candidates): the join by prefix, both bounds, and the words themselves."""
    each = found.where("size(candidates) > 0").select("key_a", "key_b", "n_words", F.explode("candidates").alias("c")).select("key_a", "key_b", "n_words", "c.*")
    once = each.groupBy("key_a", "key_b", "place", "token").agg(*(F.first(c).alias(c) for c in ("n_words", "before", "context")))  # texts that recur
    met = once.join(prefixes, "token").withColumn("start", F.col("place") - F.col("at"))
    bounded = met.where("start >= 0 and start + size <= n_words and before >= at")
    same = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("at") + 1, F.col("size")), " ") == F.col("window")
    spans = F.collect_set(F.array("start", F.col("start") + F.col("size"))).alias("all_spans")
    return bounded.where(same).groupBy("key_a", "key_b").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def joined_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Non-overlapping spans that cover the same words."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, filter_bytes: int = FILTER_BYTES, keep_text: bool = True, keys: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their hits: also returns the new columns' names, by n_words, spans and items.

    spans: non-overlapping [start, end) word ranges that windows cover; items: sorted ids of the items found. Without the text, rows are cut into words
    once and written with what was found. keys: the texts' keys (key_a, key_b) stay.
    """
    names = {k: fresh_name(docs, k) for k in ("n_words", "spans", "items")}
    one, two = (fresh_name(docs, k) for k in ("key_a", "key_b"))
    keyed = docs.withColumns(dict(zip((one, two), text_key(F.col(f"`{text_col}`")), strict=True)))
    search, prefixes = _index(docs, benchmark, text_col, item_col, item_text_col, window, filter_bytes)
    counted = (names["n_words"], "long", pa.int64())
    candidates = fresh_name(docs, "candidates")
    if keep_text:
        rows = map_columns(keyed, [text_col], [counted], lambda: lambda texts: [[len(ascii_lower_words(t)) for t in texts]])
        source = map_columns(keyed.select(F.col(one), F.col(two), F.col(f"`{text_col}`").alias("text")), ["text"], [("n_words", "long", pa.int64()), ("candidates", _CANDIDATES, _CANDIDATE)], search, drop=("text",)).withColumnsRenamed({one: "key_a", two: "key_b"})
    else:
        written = checkpointed(map_columns(keyed, [text_col], [counted, (candidates, _CANDIDATES, _CANDIDATE)], search, drop=(text_col,)))
        rows, source = written.drop(candidates), written.select(F.col(one).alias("key_a"), F.col(two).alias("key_b"), F.col(names["n_words"]).alias("n_words"), F.col(candidates).alias("candidates"))
    hit = _verified(source, prefixes)
    hit = map_columns(hit, ["all_spans"], [(names["spans"], "array<array<int>>", pa.list_(pa.list_(pa.int32())))], lambda: lambda each: [[joined_spans([tuple(s) for s in r]) for r in each]], drop=("all_spans",))
    hit = hit.withColumnsRenamed({"key_a": one, "key_b": two, "items": names["items"]})
    empty = {names[k]: F.coalesce(names[k], F.expr("array()").cast(kind)) for k, kind in (("spans", "array<array<int>>"), ("items", "array<string>"))}
    return rows.join(hit, [one, two], "left").withColumns(empty).drop(*(() if keys else (one, two))), names


def _index(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, filter_bytes: int) -> tuple[Callable[[], Callable], DataFrame]:
    """What finds occurrences of prefixes in texts, and the table of the prefixes' windows."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = checkpointed(item_windows(items, window))
    widths = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("w")).distinct().collect())  # 1 to 5
    counts = corpus_counts(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), widths, bitmap(windows.select(F.explode("tokens").alias("token")).distinct(), filter_bytes))
    prefixes = checkpointed(prefix_table(windows, counts))
    return _searcher(widths, bitmap(prefixes.select("token").distinct(), filter_bytes), window), prefixes


def contaminated(n_hit, n_words):
    """The rule: some hit, and a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hits(spans):
    """Words inside any occurrence."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that the rule does not call contaminated, with the columns they came with. Only keys of texts are joined; AQE broadcasts a short list of contaminated ones."""
    found, names = find_contamination(docs.select(F.col(f"`{text_col}`").alias("text")), benchmark, "text", keep_text=False, keys=True, **options)
    bad = checkpointed(found.where(contaminated(hits(F.col(names["spans"])), F.col(names["n_words"]))).select("key_a", "key_b").distinct())
    one, two = (fresh_name(docs, k) for k in ("key_a", "key_b"))
    marked = docs.withColumns(dict(zip((one, two), text_key(F.col(f"`{text_col}`")), strict=True)))
    return marked.join(bad.withColumnsRenamed({"key_a": one, "key_b": two}), [one, two], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_benchmark_containment(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found, names = find_contamination(docs.select("doc_id", "text"), benchmark, keep_text=False)
    n_hit, n_words, items = hits(F.col(names["spans"])), F.col(names["n_words"]), F.col(names["items"])
    return found.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated(n_hit, n_words).alias("contaminated"))


def op10_sql(size: int = WINDOW) -> str:
    """DuckDB SQL for the same rows, by plain enumeration of every document's windows."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), {size}) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM items) WHERE len(w) >= size),
found AS (SELECT DISTINCT rid, i, p.size, item_id FROM (SELECT rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM places) p JOIN windows x ON x.win = p.win AND x.size = p.size),
covered AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid),
named AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS ids FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
