"""Token counts by a count-only Viterbi pass.

The vocabulary is read as a unigram model: the best segmentation has the largest sum of piece scores. An
Aho-Corasick automaton enumerates every piece that occurs in a chunk; a dynamic programme over its positions
carries only the best score and the number of pieces so far, never the pieces themselves.

Tie rules are the tokenizer's: positions are settled from left to right, a later candidate replaces an earlier one
only if its score is strictly larger, and a character that no one-character piece covers may be an unknown of score
min - 10 (with byte fallback: as many tokens as it has bytes, three for a space, which is written as U+2581; without: unknowns in
a row are one token). A space is written before every text that is not empty. Scores are added exactly (in double precision per chunk); the library adds them in single precision, which
can only differ once a text's sum has more than 24 significant bits.

The counts are those of the tokenizer if ``model_path`` names a unigram model without text normalization; for a model of another
kind (the query's default is a BPE file, the only piece model at hand) they are the unigram counts over its pieces and scores.

Defined results: null and empty texts count 0; a literal U+2581 counts as a space, as in the library; repeated
rows repeat; an empty table gives no rows; only the named columns are read, a new column whose name is taken gets underscores.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh_name, map_columns
from .pieces import MODEL_PATH, SPACE, Memo, Vocabulary, load_vocabulary

#: Chunks whose counts a Python worker remembers.
REMEMBERED = 500_000
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        import ahocorasick

        self.vocabulary = vocabulary
        self.matches = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.surface.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.memo = Memo(self.count_chunk, remembered)
        # unknowns in a row are one token, so parts must not meet in two of them
        self.cuts = vocabulary.cuts and (bool(vocabulary.byte_ids) or {" ", "\n"} <= vocabulary.surface.keys())

    def count_chunk(self, chunk: str) -> int:
        size, unknown = len(chunk), self.vocabulary.min_score - UNKNOWN_PENALTY
        starts: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, (length, score) in self.matches.iter(chunk):
            starts[end + 1 - length].append((length, score))
        best: list[float | None] = [0.0] + [None] * size
        count, unknown_ends = [0] * (size + 1), [False] * (size + 1)
        for at in range(size):
            here, n, single = best[at], count[at] + 1, False
            for length, score in starts[at]:
                to, score = at + length, here + score
                if best[to] is None or score > best[to]:
                    best[to], count[to], unknown_ends[to] = score, n, False
                single = single or length == 1
            if not single and (best[at + 1] is None or here + unknown > best[at + 1]):
                best[at + 1], unknown_ends[at + 1] = here + unknown, True
                if self.vocabulary.byte_ids:
                    count[at + 1] = n - 1 + len(chunk[at].replace(" ", SPACE).encode())
                else:
                    count[at + 1] = n - unknown_ends[at]
        return count[size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        return sum(map(self.memo.__getitem__, self.vocabulary.chunks(text))) if self.cuts else self.count_chunk(text)


def count_tokens(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", model_path: str = MODEL_PATH, keep_text: bool = True) -> tuple[DataFrame, str]:
    """The rows with the number of tokens of each text; also returns the new column's name. No shuffle."""
    vocabulary, name = load_vocabulary(model_path), fresh_name(docs, out_col)

    def start():
        counter = Counter(vocabulary)
        return lambda texts: [[counter.count(t) for t in texts]]

    return map_columns(docs, [text_col], [(name, "long", pa.int64())], start, drop=() if keep_text else (text_col,)), name


def op8_token_counts(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), keep_text=False, model_path=model_path)[0]
