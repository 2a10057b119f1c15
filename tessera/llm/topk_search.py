"""Exact BM25 top-k search: an inverted index with block-max WAND pruning per shard, merged with global statistics.

A query is the set of distinct words of a text (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased).

The index is built once: a task turns its documents into shards of at most ``SHARD_BYTES`` of text (a longer one
alone), written to the checkpoint folder. Inside a shard, documents stand by their most frequent word, then by length,
so that the documents of a block resemble each other; postings stand by word, then by document.

Queries go out in blocks of at most ``BLOCK_BYTES`` of text. A block's document frequencies are added up over all
shards first, so a score does not depend on the shard. A query's rows are in one block. Then every shard is searched for the whole block,
and its results are written, so that nothing of a block stays with the driver or the executors when the next one begins:

* each word's postings are cut into cells of ``CELL`` or more documents with the cell's largest contribution;
* for every document block, the query's words are added up by their cells' maxima, the commonest first. The word at which
  the sum passes the threshold is the block's pivot: a document with words before it only cannot reach the
  threshold, so these cells stay closed; only cells from the pivot on are opened. Whole blocks have no pivot;
* a document whose opened contributions and closed maxima do not reach the threshold is out; the others are scored.

The threshold is the k-th best score so far. Every ``SEED``-th shard is searched first, and its k-th best scores are
the thresholds with which all other shards start; what lies below them never leaves its shard. Results are merged by
score, then least id, so they are exact: pruning only decides what is looked at.

Scores are rounded to 6 decimals before ranking; ties go to the smaller id, null ids last. Defined results: a query
without words, or whose words occur nowhere, has no results; null and empty documents match nothing but count; a
query with a null id is no query; texts under one query id ask together; repeated rows are documents of their own; an empty table gives no rows. Only the
named columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower_words, checkpointed, slices

K, K1, B = 10, 1.2, 0.75
DIGITS = 6
BLOCK_BYTES, SHARD_BYTES, SEED = 16 << 20, 32 << 20, 8
#: Documents of a cell; a word in over one in COMMON documents of a shard has cells; common words opened in one step.
CELL, COMMON, STEP = 64, 16, 16
_NULL = np.iinfo(np.int64).max
_LEAST = 10.0**-DIGITS


def joined_ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, end), in order."""
    sizes = ends - starts
    shift = starts - np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(shift, sizes) + np.arange(sizes.sum())


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of three types."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _read(data: bytes, number: int) -> np.ndarray:
    """What ``_small`` wrote: ``number`` values."""
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // number] if number else np.uint8)


class _Numbers(dict):
    """Words, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


INDEX = "shard long, n long, words long, ids binary, lengths binary, vocabulary binary, counts binary, docs binary, tfs binary"


def index_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of docs(id, text), with its postings as arrays of the smallest types that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 20) - 1
        vocabulary = _Numbers()
        ids, lengths, tops, parts, held = [], [], [], [], 0

        def finish() -> pa.RecordBatch:
            nonlocal number, vocabulary, ids, lengths, tops, parts, held
            number += 1
            n, names = len(ids), sorted(vocabulary)
            # names in byte order, so that sums over a document's words are taken in one order in every shard
            rank = np.empty(len(names), np.int64)
            rank[np.fromiter((vocabulary[w] for w in names), np.int64, len(names))] = np.arange(len(names))
            sizes, keys = np.array(lengths, np.int64), np.array(ids, np.int64)
            order = np.lexsort((keys, sizes, rank[np.array(tops, np.int64)] if names else np.zeros(n, np.int64)))
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            every = rank[np.concatenate(parts)] if names else np.zeros(0, np.int64)
            pairs = np.sort(every * n + np.repeat(place, sizes))
            first = np.nonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))[0] if len(pairs) else np.zeros(0, np.int64)
            tf, (word, doc) = np.diff(np.append(first, len(pairs))), np.divmod(pairs[first], n)
            columns = [np.ascontiguousarray(keys[order]), sizes[order], b"\n".join(names), _small(np.bincount(word, minlength=len(names))), _small(doc), _small(tf)]
            row = [[number], [n], [int(sizes.sum())], *([x if isinstance(x, bytes) else x.tobytes()] for x in columns)]
            vocabulary, ids, lengths, tops, parts, held = _Numbers(), [], [], [], [], 0
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in row[:3]), *(pa.array(x, pa.binary()) for x in row[3:])], [c.split()[0] for c in INDEX.split(", ")])

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and held + len(text or "") > shard_bytes:
                    yield finish()
                found = ascii_lower_words(text)
                words = np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found))
                ids.append(_NULL if key is None else key)
                lengths.append(len(words))
                tops.append(vocabulary[Counter(found).most_common(1)[0][0]] if found else 0)
                parts.append(words)
                held += len(text or "") + 64  # empty documents take room too
        if ids:
            yield finish()

    return docs.mapInArrow(run, INDEX)


class Shard:
    """A shard's postings of a block's words. ``scored`` and ``postings`` count what searches looked at, and what there was."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, word: np.ndarray, doc: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float):
        """word, doc, tf: postings by word, then document; words are numbered as in ``idf``."""
        self.ids, self.n = ids, len(ids)
        self.cells = -(-self.n // CELL)
        self.doc = doc.astype(np.int64)
        self.gain = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean))
        of_word = np.bincount(word, minlength=len(idf))
        self.end = np.cumsum(of_word)
        self.begin = self.end - of_word
        common = np.nonzero(of_word * COMMON > self.n)[0]
        self.row = np.full(len(idf), -1, np.int64)
        self.row[common] = np.arange(len(common))
        places = joined_ranges(self.begin[common], self.end[common])
        self.rows = np.zeros((len(common), self.cells * CELL), np.float32)
        self.rows[np.repeat(np.arange(len(common)), of_word[common]), self.doc[places]] = self.gain[places]
        self.rows = self.rows.reshape(len(common), self.cells, CELL)
        # a little above the largest, so that sums in single precision never lie below the scores
        self.top = self.rows.max(axis=2) * np.float32(1 + 1e-4)
        self.held = (self.rows > 0).sum(axis=2).astype(np.int32)
        by_doc = np.argsort(self.doc, kind="stable")
        self.doc_words, self.doc_gain = word[by_doc].astype(np.int64), self.gain[by_doc]
        self.doc_end = np.cumsum(np.bincount(self.doc, minlength=self.n))
        self.doc_begin = np.concatenate([[0], self.doc_end[:-1]]) if self.n else self.doc_end
        self.asked = np.zeros(len(idf))
        self.scored = self.postings = 0

    def exact(self, docs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The documents' rounded scores, added up in word order, so that equal texts have equal scores."""
        begin, end = self.doc_begin[docs], self.doc_end[docs]
        places = joined_ranges(begin, end)
        self.asked[words] = 1.0
        worth = self.doc_gain[places] * self.asked[self.doc_words[places]]
        self.asked[words] = 0.0
        self.scored += int((worth > 0).sum())
        return np.round(np.bincount(np.repeat(np.arange(len(docs)), end - begin), worth, len(docs)), DIGITS)

    def search(self, words: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray, seed: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the given results and this shard's documents. words: the commonest first; seed: results below it are not wanted."""
        row = self.row[words]
        rare, rows = words[row < 0], row[row >= 0]
        begin, end = self.begin[rare], self.end[rare]
        places = joined_ranges(begin, end)
        opened = np.zeros(self.cells * CELL) + np.bincount(self.doc[places], self.gain[places], self.cells * CELL)
        opened = opened.reshape(-1, CELL)
        self.postings += int((self.end[words] - self.begin[words]).sum())
        self.scored += len(places)
        closed = self.top[rows].sum(axis=0, dtype=np.float64)
        bound = closed + opened.max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # the blocks with the highest bounds come first: they raise the threshold for the others
        ahead = max(2, len(order) // 16)
        for rest in (order[:ahead], order[ahead:]):
            least = max(seed, scores[-1] if len(scores) == k else 0.0) * (1 - 1e-5) - _LEAST
            rest = rest[bound[rest] > least]
            docs = self._reaching(rest, rows, opened[rest].astype(np.float32), closed[rest], max(least, 0.0), k)
            if len(docs):
                scores, ids = self._merged(docs[docs < self.n], words, k, scores, ids)
        return scores, ids

    def _reaching(self, blocks: np.ndarray, rows: np.ndarray, some: np.ndarray, left: np.ndarray, least: float, k: int) -> np.ndarray:
        """Documents of the blocks that can be among the best k over ``least``.

        some: contributions opened so far; left: what the closed cells may add. The pivot moves down the common words,
        the rarest first; blocks that can't reach the threshold drop out.
        """
        for upto in range(len(rows), 0, -STEP):
            if not len(blocks):
                break
            now = rows[max(0, upto - STEP) : upto, None]
            some += self.rows[now, blocks].sum(axis=0)
            left = left - self.top[now, blocks].sum(axis=0)
            self.scored += int(self.held[now, blocks].sum())
            keep = some.max(axis=1) + left > least
            blocks, some, left = blocks[keep], some[keep], left[keep]
        if some.size > k:
            least = max(least, float(np.partition(some.ravel(), -k)[-k]) * (1 - 1e-5) - 2 * _LEAST)
        places, at = np.nonzero(some > least)
        return blocks[places] * CELL + at

    def _merged(self, docs: np.ndarray, words: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.exact(docs, words)
        hit = got > 0
        scores, ids = np.concatenate([scores, got[hit]]), np.concatenate([ids, self.ids[docs[hit]]])
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]


def load_shard(row: dict, number: dict[bytes, int], idf: np.ndarray, mean: float) -> Shard:
    """An index row, cut down to the words of a query block."""
    ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
    names = row["vocabulary"].split(b"\n") if row["vocabulary"] else []
    counts = _read(row["counts"], len(names)).astype(np.int64)
    total = int(counts.sum())
    of_name = np.fromiter((number.get(w, -1) for w in names), np.int64, len(names))
    kept = np.repeat(of_name >= 0, counts)
    word = np.repeat(of_name, counts)[kept]  # numbers follow the words' byte order, as the names do
    return Shard(ids, lengths, word, _read(row["docs"], total)[kept], _read(row["tfs"], total)[kept].astype(np.float64), idf, mean)


def document_counts(index: DataFrame, vocabulary) -> dict[bytes, int]:
    """In how many documents each word of the broadcast vocabulary occurs; pre-aggregated by partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in slices(batches, 1):
            data, counts = (c[0].as_py() for c in batch.columns)
            names = data.split(b"\n") if data else []
            number = vocabulary.value
            for name, n in zip(names, _read(counts, len(names)).tolist(), strict=True):
                if name in number:
                    total[name] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = index.select("vocabulary", "counts").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}  # at most the block's words


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_col: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k best documents of each query. Ids are whole numbers."""
    spark = docs.sparkSession
    index = checkpointed(index_documents(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), shard_bytes))
    asked = queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(query_col).cast("string").alias("text")).where("id is not null").distinct()
    asked = checkpointed(asked)  # read once a block
    totals = index.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n, mean = totals["n"] or 0, max(1e-9, (totals["words"] or 0) / max(1, totals["n"] or 0))
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = 1 if size <= block_bytes else 2 * (1 + size // block_bytes)  # twice, so that hashing leaves each below the bound
    seeding = F.pmod(F.xxhash64("shard"), F.lit(SEED)) == 0
    parts = None
    for block in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).collect()  # about block_bytes of text
        sets: dict[int, set[bytes]] = {}
        for r in rows:
            sets.setdefault(r["id"], set()).update(ascii_lower_words(r["text"]))
        names = sorted(set().union(*sets.values())) if sets else []
        number = {w: i for i, w in enumerate(names)}
        vocabulary = spark.sparkContext.broadcast(number)
        df = document_counts(index, vocabulary) if names else {}
        seen = np.array([df.get(w, 0) for w in names], np.float64)
        asking = {}
        for q, ws in sets.items():
            of = np.array(sorted(number[w] for w in ws), np.int64)
            of = of[seen[of] > 0]
            asking[q] = of[np.argsort(-seen[of], kind="stable")]
        weights = spark.sparkContext.broadcast((np.log(1 + (n - seen + 0.5) / (seen + 0.5)), {q: ws for q, ws in asking.items() if len(ws)}))
        first = checkpointed(index.where(seeding).mapInArrow(_searcher(vocabulary, weights, mean, k), RESULT))
        seeds = {r["query_id"]: r["least"] for r in first.groupBy("query_id").agg(F.get(F.slice(F.reverse(F.array_sort(F.collect_list("score"))), k, 1), 0).alias("least")).where("least is not null").collect()}  # a number per query of the block
        least = spark.sparkContext.broadcast(seeds)
        found = first.union(checkpointed(index.where(~seeding).mapInArrow(_searcher(vocabulary, weights, mean, k, least), RESULT)))
        for sent in (vocabulary, weights, least):
            sent.destroy()
        parts = found if parts is None else parts.union(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


RESULT = "query_id long, id long, score double"


def _searcher(vocabulary, weights, mean: float, k: int, seeds=None):
    """vocabulary, weights, seeds: broadcasts of the words' numbers, of their idf with each query's words, and of each query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, (idf, asked), least = vocabulary.value, weights.value, seeds.value if seeds else {}
        best = {q: (np.zeros(0), np.zeros(0, np.int64)) for q in asked}
        for batch in slices(batches, 1):
            shard = load_shard({name: batch.column(i)[0].as_py() for i, name in enumerate(batch.schema.names)}, number, idf, mean)
            for q, words in asked.items():
                best[q] = shard.search(words, k, *best[q], least.get(q, 0.0))
        sizes = [len(s) for s, _ in best.values()]
        if sum(sizes):
            found = np.concatenate([i for _, i in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), sizes)), pa.array(found, mask=found == _NULL), pa.array(np.concatenate([s for s, _ in best.values()]))], ["query_id", "id", "score"])

    return run


def op6_block_max_wand(docs: DataFrame) -> DataFrame:
    """Every document whose id is divisible by 100 asks with its whole text."""
    return search(docs, docs.where("doc_id % 100 = 0")).select(F.col("query_id").alias("query_doc_id"), "rank", F.col("id").alias("doc_id"), "score")


def op6_sql(k: int = K) -> str:
    """DuckDB SQL for the same rows, scoring every document."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
totals AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM docs),
tf AS (SELECT rid, word, count(*) AS tf FROM (SELECT rid, unnest(w) AS word FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT doc_id AS query_doc_id, unnest(w) AS word FROM docs WHERE doc_id % 100 = 0),
idf AS (SELECT word, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), totals),
scored AS (SELECT query_doc_id, doc_id, rid, round(sum(idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len(w) / mean))), {DIGITS}) AS score
  FROM asked JOIN tf USING (word) JOIN idf USING (word) JOIN docs USING (rid), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_doc_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored)
SELECT query_doc_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
