"""Every occurrence of a chunk draws its own dropout."""

from collections import Counter

import numpy as np

from tessera.llm import merge_dropout
from tessera.llm.pieces import MODEL_PATH, load_vocabulary


def cut_by_chance(encoder, word, rng):
    """The agenda's definition with a fresh random number for every candidate."""
    parts, skipped = list(enumerate(word)), set()
    while pairs := [(encoder.costs[a + b], i, k, a + b) for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in encoder.costs and (i, a + b) not in skipped]:
        _, i, k, pair = min(pairs)
        if rng.random() < 0.1:
            skipped.add((i, pair))
        else:
            parts[k : k + 2] = [(i, pair)]
    return np.array(encoder.ids_of([s for _, s in parts]), np.int32).tobytes()


def test_each_document_cuts_a_word_anew():
    encoder, rng = merge_dropout.Encoder(load_vocabulary(MODEL_PATH)), np.random.default_rng(1)
    number, most = 6000, 0
    for word in ("the", "station", "government"):
        cuts = Counter(encoder.encode_many([word] * number, list(map(str, range(number)))))
        chance = Counter(cut_by_chance(encoder, " " + word, rng) for _ in range(number))
        assert all(abs(cuts[c] - chance[c]) < 0.03 * number for c in cuts | chance)
        most = max(most, len(cuts))
    assert most > 20


def test_two_candidates_are_skipped_independently():
    encoder = merge_dropout.Encoder(load_vocabulary(MODEL_PATH))
    encoder.encode("government")
    run = encoder.roots[" government"]
    words = encoder.words[encoder.starts[run] :][: encoder.counts[run]]
    key, factor = encoder.draws("1", 200_000)
    skipped = (key[:, None] ^ words) * factor[:, None] < encoder.below
    both = (skipped.T.astype(float) @ skipped) / len(key)
    assert np.allclose(np.diag(both), 0.1, atol=0.005) and np.allclose(both[~np.eye(len(words), dtype=bool)], 0.01, atol=0.005)


def test_shortcut_equals_the_agenda(spark):
    """Texts encoded with what is remembered are those of a heap run for every occurrence."""
    encoder = merge_dropout.Encoder(load_vocabulary(MODEL_PATH), dropout=0.2, remembered=100)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    texts, keys = [r["text"] for r in rows] + ["", None, "x" * 90], [str(r["doc_id"]) for r in rows] + ["a", "b", None]
    for text, key, got in zip(texts, keys, encoder.encode_many(texts, keys), strict=True):
        chunks = encoder.vocabulary.chunks(" " + text) if text else []
        draws = zip(*encoder.draws(key, len(chunks)), strict=True)
        want = [i for c, (k, f) in zip(chunks, draws, strict=True) for i in encoder.ids_of(encoder.merged(list(c), int(k), int(f)))]
        assert np.frombuffer(got, np.int32).tolist() == want
        assert encoder.encode(text, key) == got
