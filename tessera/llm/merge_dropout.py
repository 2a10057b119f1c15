"""SentencePiece encoding with seeded merge-dropout, and decoding.

A chunk starts as single characters. An agenda holds the adjacent pairs that form a piece, best score first, then
leftmost. Each candidate taken from the agenda is skipped where a hash keyed by the seed falls below the dropout
rate; skipped pairs come back only if a neighbour changes. With rate 0 the result is the tokenizer's own.

The hash is keyed by (seed, document key, the chunk's place in the text, place, piece), places in a chunk counted modulo 4096, so that every
occurrence of a word draws anew, yet every run, partitioning and retry gives the same pieces. Two kinds of runs of the agenda are remembered,
with the candidates they take: that of a chunk without dropout, and that which skips one of its candidates (from its second
use on). An occurrence that skips none of a run's candidates has that run's pieces; one with other skips runs the agenda itself.

Decoding joins the pieces' bytes and takes off the space that encoding put first. It is lossless for every text: a
literal U+2581, which is no piece here, and all other uncovered characters become bytes.

Defined results: null is encoded as null ids, the empty text as no ids (the query counts both as no pieces, lossless); a null
key is a key of its own; repeated rows repeat, with the same pieces where the key is the same; an empty table gives no
rows. Only the named columns are read; a new column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, map_columns
from .pieces import MODEL_PATH, Vocabulary, load_vocabulary

DROPOUT, SEED = 0.1, 2024
#: A worker forgets its runs before a slice of rows once it holds so many.
REMEMBERED = 150_000
#: Rows whose new chunks are encoded together.
ROWS = 256
_MASK = (1 << 64) - 1
_WORD = (1 << 32) - 1
_TURNS = 4096
#: Characters up to which chunks share one array, chunks in one array, and the bits of a place in it.
SHORT, _TOGETHER, _PLACE_BITS = 40, 4096, 6
#: Bits of a slot in the tables of pairs.
_SLOT_BITS = 19
_NONE = 1 << 40


def _mixed(x: int) -> int:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    """``_mixed`` of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShortAgendas:
    """The agendas of many short chunks at once, as arrays of (place, chunk).

    A candidate's rank by cost and its place are one number, so the least of a column is the best and leftmost one.
    Every step takes one candidate of each chunk, which is skipped or merged by the same hash as in ``Encoder.merged``.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[int]):
        pieces = list(vocabulary.surface)
        symbol = {s: i for i, s in enumerate(pieces)}
        for char in sorted({c for s in pieces for c in s} - symbol.keys()):
            symbol[char] = len(symbol)  # no piece itself, but part of one
        costs = np.array([-score for _, score in vocabulary.surface.values()])
        self.rank = np.unique(costs, return_inverse=True)[1].astype(np.int64) << _PLACE_BITS
        self.ids = np.full(len(symbol) + 1, -1, np.int32)  # the last entry stands for characters in no piece
        self.ids[: len(pieces)] = [i for i, _ in vocabulary.surface.values()]
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.salts, self.places = np.array(words[: len(pieces)], np.uint32), np.array(words[len(pieces) : len(pieces) + SHORT], np.uint32)
        self.width = len(symbol)
        joins = {symbol[s[:k]] * self.width + symbol[s[k:]]: i for i, s in enumerate(pieces) for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol}
        self.pairs, self.made = (np.array(x, np.int64) for x in zip(*sorted(joins.items()), strict=True)) if joins else (np.zeros(0, np.int64),) * 2
        self.pairs = np.append(self.pairs, -1)  # what an empty slot points to
        # places of the pairs by hash; a pair whose slot is taken goes to the second table, then to the rest
        self.slots, self.rest = np.full((2, 1 << _SLOT_BITS), len(self.made), np.int32), np.arange(len(self.made))
        for table, slot in zip(self.slots, self.slots_of(self.pairs[:-1]), strict=True):
            table[slot[self.rest[::-1]]] = self.rest[::-1]
            self.rest = self.rest[table[slot[self.rest]] != self.rest]

    @staticmethod
    def slots_of(pairs: np.ndarray) -> list[np.ndarray]:
        mixed = pairs.astype(np.uint64)
        return [(mixed * np.uint64(odd) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        wanted = np.where((left >= 0) & (right >= 0), left * self.width + right, -2)
        one, two = self.slots_of(wanted)
        at = self.slots[0][one]
        other = np.nonzero((self.pairs[at] != wanted) & (at < len(self.made)))
        at[other] = self.slots[1][two[other]]
        known = self.pairs[at] == wanted
        if len(self.rest):
            late = np.nonzero(~known)
            place = np.minimum(np.searchsorted(self.pairs[self.rest], wanted[late]), len(self.rest) - 1)
            at[late] = self.rest[place]
            known = self.pairs[at] == wanted
        return np.where(known, np.append(self.made, -1)[at], -1)

    def run(self, chunks: list[str], keys: np.ndarray, factors: np.ndarray, below: int, taken: list | None = None, skips: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, alive), one row per chunk; -1 is a character in no piece. ``taken`` gets each step's columns and candidates' words.

        skips: instead of the hash, the word of the candidate that each chunk skips.
        """
        n, sizes = len(chunks), np.array([len(c) for c in chunks])
        high = int(sizes.max())
        places = np.arange(high)[:, None]
        symbols = self.of_char[np.frombuffer("".join([c.ljust(high, "\0") for c in chunks]).encode("utf-32-le"), np.uint32)].astype(np.int64).reshape(n, high).T.copy()
        alive = places < sizes
        symbols[~alive] = -1
        pair = np.full((high, n), -1, np.int64)
        pair[:-1] = self.joined(symbols[:-1], symbols[1:])
        agenda = np.where(pair >= 0, self.rank[pair] + places, _NONE)
        ahead, behind = np.repeat(places + 1, n, 1), np.repeat(places - 1, n, 1)
        columns = np.arange(n)
        while len(columns):
            best = (agenda if len(columns) == n else agenda[:, columns]).min(axis=0)
            going = best < _NONE
            columns, at = columns[going], best[going] & (1 << _PLACE_BITS) - 1
            piece = pair[at, columns]
            agenda[at, columns] = _NONE
            words = self.salts[piece] ^ self.places[at]
            if taken is not None:
                taken.append((columns, words))
            merge = (keys[columns] ^ words) * factors[columns] >= below if skips is None else skips[columns] != words
            at, piece, here = at[merge], piece[merge], columns[merge]
            right = ahead[at, here]
            symbols[at, here], alive[right, here], agenda[right, here] = piece, False, _NONE
            after, before = ahead[right, here], behind[at, here]
            ahead[at, here] = after
            for place, one, two, ok in ((at, at, after, after < sizes[here]), (before, before, at, before >= 0)):
                place, one, two, there = place[ok], one[ok], two[ok], here[ok]
                wider = self.joined(symbols[one, there], symbols[two, there])
                pair[place, there] = wider
                agenda[place, there] = np.where(wider >= 0, self.rank[wider] + place, _NONE)
            ok = after < sizes[here]
            behind[after[ok], here[ok]] = at[ok]
        return symbols.T, alive.T


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED, remembered: int = REMEMBERED):
        self.vocabulary, self.below, self.seed = vocabulary, int(dropout * (1 << 32)), seed & _WORD
        self.remembered = remembered
        self.merges = {s: i for s, (i, _) in vocabulary.surface.items()}
        self.costs = {s: -score for s, (_, score) in vocabulary.surface.items()}
        # tabulation hashing: seeded random words of the piece and of the place, joined with the chunk's key; the odd
        # factor of an occurrence keeps its candidates from excluding each other
        words = np.random.Generator(np.random.Philox(key=seed + 1)).integers(0, 1 << 32, len(self.costs) + _TURNS).tolist()
        self.salts, self.places = dict(zip(self.costs, words, strict=False)), words[len(self.costs) :]
        self.short = ShortAgendas(vocabulary, words)
        self.forget()

    def forget(self) -> None:
        self.roots: dict[str, int] = {}  # the run of a chunk without skips; -1: a long chunk
        self.chunks: list[str] = []  # by run, as are the ids, the first candidate and the number of candidates
        self.ids: list[bytes] = []
        self.starts, self.counts = (np.zeros(1 << 10, np.int64) for _ in range(2))
        #: of every candidate: its word, its place among all that its run takes, and the run that skips it (-1: not used, -2: once)
        self.words, self.at, self.next = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.taken = 0

    def key_of(self, chunk: str, variant: int) -> int:
        return _mixed(zlib.crc32(chunk.encode()) ^ (self.seed << 32) ^ (variant << 56) & _MASK) & _WORD if self.below else 0

    def encode_chunks(self, chunks: list[str], variant: int) -> list[bytes]:
        """The ids of each chunk, keyed by the chunk and a number."""
        return self.encode_keyed(chunks, np.array([self.key_of(c, variant) for c in chunks], np.uint32), np.ones(len(chunks), np.uint32))

    def encode_keyed(self, chunks: list[str], keys: np.ndarray, factors: np.ndarray) -> list[bytes]:
        """The ids of each chunk with its own key and factor: short ones together, the others one by one."""
        out = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        longer = int(np.searchsorted(sizes[order], SHORT, side="right"))
        for i in order[longer:].tolist():
            out[i] = array("i", self.ids_of(self.merged(list(chunks[i]), int(keys[i]), int(factors[i])))).tobytes()
        for begin in range(0, longer, _TOGETHER):
            block = order[begin : min(longer, begin + _TOGETHER)]
            for i, ids in zip(block.tolist(), self.together([chunks[i] for i in block.tolist()], keys[block], factors[block], self.below), strict=True):
                out[i] = ids
        return out

    def together(self, texts: list[str], keys: np.ndarray, factors: np.ndarray, below: int, taken: list | None = None, skips: np.ndarray | None = None) -> list[bytes]:
        """The ids of short chunks by one array."""
        symbols, alive = self.short.run(texts, keys, factors, below, taken, skips)
        ids = self.short.ids[symbols]
        data, ends = ids[alive].tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.nonzero((alive & (ids < 0)).any(axis=1))[0].tolist():
            row: list[int] = []
            for at in np.nonzero(alive[k])[0].tolist():
                row += [int(ids[k, at])] if ids[k, at] >= 0 else self.vocabulary.ids_of_unknown(texts[k][at])
            out[k] = array("i", row).tobytes()
        return out

    def remember(self, chunks: list[str], skips: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The numbers of new runs, each with one skip (-1: none); their candidates are those after the given places."""
        numbers = np.empty(len(chunks), np.int64)
        order = np.argsort(np.fromiter(map(len, chunks), np.int64, len(chunks)), kind="stable")
        for begin in range(0, len(chunks), _TOGETHER):
            block = order[begin : begin + _TOGETHER]
            texts, mine, taken = [chunks[i] for i in block.tolist()], skips[block], []
            zeros, known = np.zeros(len(texts), np.uint32), len(self.ids)
            self.ids += self.together(texts, zeros, zeros, 0, taken, mine)
            self.chunks += texts
            columns = np.concatenate([c for c, _ in taken]) if taken else np.zeros(0, np.int64)
            by_run = np.argsort(columns, kind="stable")
            columns, words = columns[by_run], np.concatenate([w for _, w in taken])[by_run] if taken else np.zeros(0, np.uint32)
            many = np.bincount(columns, minlength=len(texts))
            at = np.arange(len(columns)) - np.repeat(np.cumsum(many) - many, many)
            fresh = np.nonzero((at >= after[block][columns]) & (mine[columns] != words))[0]
            many = np.bincount(columns[fresh], minlength=len(texts))
            begin, end = self.taken, self.taken + len(fresh)
            for name, first, values in (("starts", known, begin + np.cumsum(many) - many), ("counts", known, many), ("words", begin, words[fresh]), ("at", begin, at[fresh]), ("next", begin, np.full(len(fresh), -1))):
                held = getattr(self, name)
                if first + len(values) > len(held):
                    held = np.concatenate([held, np.zeros(len(held) + len(values), held.dtype)])
                    setattr(self, name, held)
                held[first : first + len(values)] = values
            self.taken = end
            numbers[block] = np.arange(known, len(self.ids))
        return numbers

    def skipping(self, going: np.ndarray, run: np.ndarray, key: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the given occurrences those that skip a candidate of their run, and the first such candidate."""
        sizes, starts = self.counts[run[going]], self.starts[run[going]]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        skipped = np.nonzero((np.repeat(key[going], sizes) ^ self.words[at]) * np.repeat(factor[going], sizes) < self.below)[0]
        place = np.searchsorted(ends, skipped, side="right")
        first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        return going[place[first]], at[skipped[first]]

    def encode_chunk(self, chunk: str, variant: int) -> list[int]:
        """The agenda over one chunk."""
        return self.ids_of(self.merged(list(chunk), self.key_of(chunk, variant)))

    def ids_of(self, symbols: list[str]) -> list[int]:
        merges = self.merges
        out: list[int] = []
        for s in symbols:
            if s in merges:
                out.append(merges[s])
            elif s:
                out += self.vocabulary.ids_of_unknown(s)
        return out

    def merged(self, symbols: list[str], key: int, factor: int = 1) -> list[str]:
        """The agenda over a chunk's characters; merged symbols leave empty strings behind."""
        costs, salts, places, below, size = self.costs, self.salts, self.places, self.below, len(symbols)
        ahead, behind = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = [(costs[pair], at, pair) for at in range(size - 1) if (pair := symbols[at] + symbols[at + 1]) in costs]
        heapify(agenda)
        while agenda:
            _, at, pair = heappop(agenda)
            right = ahead[at]
            if not symbols[at] or right >= size or symbols[at] + symbols[right] != pair:
                continue  # a part of it has been merged since
            if (key ^ salts[pair] ^ places[at % _TURNS]) * factor & _WORD < below:
                continue
            symbols[at], symbols[right] = pair, ""
            ahead[at] = right = ahead[right]
            if right < size:
                behind[right] = at
                if (wider := pair + symbols[right]) in costs:
                    heappush(agenda, (costs[wider], at, wider))
            if (left := behind[at]) >= 0 and (wider := symbols[left] + pair) in costs:
                heappush(agenda, (costs[wider], left, wider))
        return symbols

    def draws(self, key: str | None, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The key and the factor (odd) of each of a text's chunks, by the text's key and the chunk's place."""
        named = hashlib.blake2b(f"{self.seed}".encode() if key is None else f"{self.seed}:{key}".encode(), digest_size=8).digest()
        mixed = _mixed_all(np.uint64(int.from_bytes(named)) + np.arange(number, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (mixed & np.uint64(_WORD)).astype(np.uint32), (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def encode_many(self, texts: list[str | None], keys: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers. All chunks that need the agenda are encoded together."""
        if len(self.ids) >= self.remembered:
            self.forget()
        rows = [self.vocabulary.chunks(" " + text) if text else [] for text in texts]
        ends = np.cumsum([len(r) for r in rows]).tolist()
        every = [c for r in rows for c in r]
        if not every:
            return [b""] * len(rows)
        drawn = [self.draws(k, len(r)) for k, r in zip(keys, rows, strict=True)]
        key, factor = (np.concatenate(x) for x in zip(*drawn, strict=True))
        new = [c for c in dict.fromkeys(every) if c not in self.roots]
        short = [c for c in new if len(c) <= SHORT]
        self.roots.update(dict.fromkeys(new, -1))
        self.roots.update(zip(short, self.remember(short, np.full(len(short), -1), np.zeros(len(short), np.int64)).tolist(), strict=True))
        run = np.fromiter(map(self.roots.__getitem__, every), np.int64, len(every))
        if self.below:
            going, at = self.skipping(np.nonzero(run >= 0)[0], run, key, factor)
            slots, times = np.unique(at, return_counts=True)
            new = slots[(self.next[slots] == -2) | ((self.next[slots] == -1) & (times > 1))]
            self.next[slots[self.next[slots] == -1]] = -2
            owners = np.searchsorted(self.starts[: len(self.ids)], new, side="right") - 1  # runs lie one after the other
            self.next[new] = self.remember([self.chunks[i] for i in owners.tolist()], self.words[new].astype(np.int64), self.at[new] + 1)
            run[going] = np.maximum(self.next[at], -1)
            going = going[run[going] >= 0]
            run[self.skipping(going, run, key, factor)[0]] = -1
        longer = np.nonzero(run < 0)[0]
        ids = self.ids
        out = [ids[i] if i >= 0 else b"" for i in run.tolist()]
        for i, coded in zip(longer.tolist(), self.encode_keyed([every[i] for i in longer.tolist()], key[longer], factor[longer]), strict=True):
            out[i] = coded
        return [b"".join(out[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str | None, key: str | None = None) -> bytes:
        return self.encode_many([text], [key])[0]


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text that was encoded. Ids of control pieces stand for nothing."""
    return b"".join(map(vocabulary.table.__getitem__, ids)).removeprefix(b" ").decode()


def encode_texts(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED, out_col: str = "ids") -> tuple[DataFrame, str]:
    """The rows with ``array<int>`` piece ids; also returns the new column's name. No shuffle."""
    vocabulary, name = load_vocabulary(model_path), fresh_name(docs, out_col)

    def start():
        encoder = Encoder(vocabulary, dropout, seed)

        def encode(texts, keys):
            coded = encoder.encode_many(texts, [None if k is None else str(k) for k in keys])
            return [[None if t is None else np.frombuffer(c, np.int32) for t, c in zip(texts, coded, strict=True)]]

        return encode

    return map_columns(docs, [text_col, key_col], [(name, "array<int>", pa.list_(pa.int32()))], start, rows=ROWS), name


def decode_texts(encoded: DataFrame, ids_col: str = "ids", model_path: str = MODEL_PATH, out_col: str = "decoded") -> tuple[DataFrame, str]:
    """The rows with the decoded text; also returns the new column's name."""
    vocabulary, name = load_vocabulary(model_path), fresh_name(encoded, out_col)
    return map_columns(encoded, [ids_col], [(name, "string", pa.string())], lambda: lambda rows: [[None if r is None else decode(r, vocabulary) for r in rows]], rows=64), name


def round_trip(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED, out_col: str = "ids", check_col: str = "lossless") -> DataFrame:
    """The rows with their piece ids and whether these decode to the text (null ids to null), in one pass of one worker."""
    vocabulary, name, check = load_vocabulary(model_path), fresh_name(docs, out_col), fresh_name(docs, check_col)

    def start():
        encoder = Encoder(vocabulary, dropout, seed)

        def both(texts, keys):
            coded = encoder.encode_many(texts, [None if k is None else str(k) for k in keys])
            ids = [None if t is None else np.frombuffer(c, np.int32) for t, c in zip(texts, coded, strict=True)]
            return [ids, [t is None or decode(i.tolist(), vocabulary) == t for t, i in zip(texts, ids, strict=True)]]

        return both

    return map_columns(docs, [text_col, key_col], [(name, "array<int>", pa.list_(pa.int32())), (check, "boolean", pa.bool_())], start, rows=ROWS)


def op1_merge_dropout(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Per document: characters, pieces, a digest of the ids (decimal, comma-joined), and whether decoding gives the text."""
    vocabulary = load_vocabulary(model_path)

    def start():
        encoder = Encoder(vocabulary)

        def digest(texts, keys):
            coded = encoder.encode_many(texts, [None if k is None else str(k) for k in keys])
            sizes = [len(c) // 4 for c in coded]
            every = np.frombuffer(b"".join(coded), np.int32)
            written = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pc.cast(pa.array(every), pa.string())), ",").to_pylist()
            numbers, ends = every.tolist(), np.cumsum(sizes).tolist()
            same = [decode(numbers[end - size : end], vocabulary) == (t or "") for t, size, end in zip(texts, sizes, ends, strict=True)]
            return [[len(t or "") for t in texts], sizes, [hashlib.sha256(w.encode()).hexdigest() for w in written], same]

        return digest

    fields = [("n_chars", "long", pa.int64()), ("n_pieces", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("lossless", "boolean", pa.bool_())]
    return map_columns(docs.select("doc_id", "text"), ["text", "doc_id"], fields, start, rows=ROWS, drop=("text",))
