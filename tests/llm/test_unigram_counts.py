"""Counts against the library on a unigram model that is put together here (not trained), with ties and unknowns."""

import math
import struct

import pytest

from tessera.llm.pieces import MODEL_PATH, SPACE, load_vocabulary
from tessera.llm.token_counts import Counter, count_tokens


def field(number, data):
    """One field of a protocol buffer: bytes, a float or a whole number."""
    if isinstance(data, bytes):
        return varint(number << 3 | 2) + varint(len(data)) + data
    if isinstance(data, float):
        return varint(number << 3 | 5) + struct.pack("<f", data)
    return varint(number << 3) + varint(data)


def varint(n):
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def unigram_model(pieces, byte_fallback):
    """A model file: pieces with scores, identity normalization, a space before every text."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    rows += [(p, s, 1) for p, s in pieces]
    body = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, kind)) for p, s, kind in rows)
    trainer = field(3, 1) + field(4, len(rows)) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2)
    return body + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


#: Scores are multiples of 1/8: sums are exact in single precision, so the library's ties are ties here too.
def scored(kind):
    pieces = [p for p, _ in sorted(load_vocabulary(MODEL_PATH).surface.items(), key=lambda x: x[1][0])]
    pieces = [p.replace(" ", SPACE) for p in pieces if len(p) < 12 and "\n" not in p][:6000]
    if kind == "ranked":
        return [(p, -round(8 * math.log(i + 2)) / 8) for i, p in enumerate(pieces)]
    if kind == "by_length":  # many ties: every segmentation into pieces of equal lengths
        return [(p, -float(len(p))) for p in pieces]
    return [(p, -4.0) for p in pieces]


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("kind", ["ranked", "by_length", "flat"])
def test_counts_are_the_librarys(spark, tmp_path, kind, byte_fallback):
    import sentencepiece

    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(scored(kind), byte_fallback))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    counter = Counter(load_vocabulary(str(path)))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts += ["", "a", " ", "  two  spaces ", "日本語 unknown ☃☃", "a" * 500, "\ttab\n\nlines\n", "x▁y", "é" * 60, "zz☃☃zz"]
    for t in texts:
        assert counter.count(t) == len(library.encode(t)), t[:80]


def test_query_column(spark, tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(scored("ranked"), True))
    docs = spark.createDataFrame([(1, "the station", 7), (2, None, 7), (3, "", 7)], "doc_id long, text string, n_tokens int")
    rows, name = count_tokens(docs, model_path=str(path))
    assert name == "_n_tokens" and [r[name] for r in rows.orderBy("doc_id").collect()][1:] == [0, 0]
    assert count_tokens(docs.where("doc_id = 9"), model_path=str(path))[0].count() == 0
