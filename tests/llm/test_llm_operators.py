"""The numbered operators against SQL, brute force and hard rows."""

import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fixity, html_text, licenses, line_crf, merge_dropout, queries, secrets_scan, simhash, token_counts, topk_search
from tessera.llm.pieces import MODEL_PATH, load_vocabulary

from sql_check import same_rows

SF = "/root/testdata/sf0.001"
HARD = [(None, "null id", "x"), (1, None, "x"), (2, "", None), (3, "word " * 30_000, "x"), (3, "word " * 30_000, "x"), (4, "token = 'abcDEF123456ghi'\nall rights reserved", "x"), (5, "a", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty, very long and repeated texts; columns whose names clash with what operators add."""
    return spark.createDataFrame(HARD, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("score", "spans", "ids", "n_tokens", "host", "rank")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same_rows(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


OPERATORS = {
    "op1": merge_dropout.op1_merge_dropout, "op2": secrets_scan.op2_randomness_battery, "op4": simhash.op4_golay_simhash, "op8": token_counts.op8_token_counts, "op9": licenses.op9_license_templates,
    "op10": lambda d: decontaminate.op10_benchmark_containment(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "op5": lambda d: line_crf.op5_line_crf_quality(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(hard, name):
    assert OPERATORS[name](hard).count() == len(HARD)
    assert OPERATORS[name](hard.where("doc_id = 99")).count() == 0


def test_hard_search(hard):
    assert topk_search.op6_block_max_wand(hard).count() == 0
    got = topk_search.search(hard, hard.where("doc_id = 3")).collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in got] == [(3, 1, 3), (3, 2, 3)]
    assert topk_search.search(hard.where("doc_id = 99"), hard).count() == 0


def test_hard_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://h/a", ""), (1, "http://h/a", ""), (2, "http://h/b", "<p>x &amp; y"), (60, "u", "<nav>m</nav><p>z</p>")], "page_id long, url string, html string").withColumn("host", F.lit(1))
    assert sorted((r["text"], r["n_chars"]) for r in html_text.op3_site_templates(pages).collect()) == [("", 0), ("", 0), ("", 0), ("x & y", 5), ("z", 1)]
    assert [(r["page_id"], r["status"]) for r in fixity.op7_merkle_fixity(pages).collect()] == [(60, "missing")]
    assert fixity.op7_merkle_fixity(pages.where("page_id = 99")).count() == 0


def test_fixity_finds_each_kind(spark):
    first = spark.range(3000).select(F.lit("f").alias("file"), (F.col("id") * 1000).alias("offset"), F.lit(1000).cast("long").alias("length"), F.col("id").cast("string").alias("digest"))
    second = first.where("offset <> 5000").withColumn("digest", F.when(F.col("offset") == 2_000_000, "bad").otherwise(F.col("digest"))).union(first.where("offset = 7000").withColumn("file", F.lit("g")))
    assert sorted(map(tuple, fixity.audit(first, second).collect())) == [("f", 5000, "missing"), ("f", 2_000_000, "changed"), ("g", 7000, "extra")]
    assert fixity.audit(first, first).count() == 0


def secrets_by_loop(text):
    found = [("assign", m) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 12]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted((m.start(), ("assign", "access", "hex").index(k), m.end()) for k, m in found)


def test_secrets_brute_force(docs):
    rows = {r["doc_id"]: r for r in secrets_scan.op2_randomness_battery(docs).collect()}
    for r in docs.collect():
        spans = [s.split(":") for s in rows[r["doc_id"]]["spans"].split(",") if s]
        assert [(int(a), ("assign", "access", "hex").index(k), int(b)) for k, a, b in spans if k != "random"] == secrets_by_loop(r["text"])


def test_redaction(docs):
    clean = secrets_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert all(not secrets_by_loop(r["text"]) and len(r["text"]) == r["n_chars"] for r in clean.where("text like '%<secret>%'").collect())


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [2, 128])
def test_simhash_brute_force(docs, bucket):
    rows = simhash.near_duplicates(docs, bucket=bucket).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = [simhash.fingerprint(texts[r["doc_id"]]) for r in rows]
    assert [r["fp"] % 2**64 for r in rows] == fps
    assert [r["component_id"] for r in rows] == [rows[i]["doc_id"] for i in components(fps)]


def test_golay_buckets_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for errors in ((), (0,), (63,), (3, 40), (10, 11), (22, 23), (45, 46)):
        other = base.copy()
        for e in errors:
            other ^= np.uint64(1 << e)
        sides = [dict() for _ in range(2)]
        for side, fps in zip(sides, (base, other), strict=True):
            for key, place, own in zip(*simhash.bucket_keys(fps), strict=True):
                side.setdefault(place, {})[key] = own
        assert all(any(sides[0][i][k] or sides[1][i][k] for k in sides[0][i].keys() & sides[1][i].keys()) for i in range(200))


def test_encoding_without_dropout_is_the_tokenizers_own(docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    encoder, counter = merge_dropout.Encoder(load_vocabulary(MODEL_PATH), dropout=0.0), None
    for r in docs.limit(40).collect():
        assert np.frombuffer(encoder.encode(r["text"]), np.int32).tolist() == own.encode(r["text"]), counter


def merges_by_scan(encoder, chunk, variant):
    """The agenda's definition, by looking at every pair before each merge."""
    key = merge_dropout._mixed(zlib.crc32(chunk.encode()) ^ (encoder.seed << 32) ^ (variant << 56) & merge_dropout._MASK) % 2**32
    parts, skipped = [(i, c) for i, c in enumerate(chunk)], set()
    while True:
        pairs = [(encoder.costs[a + b], i, k, a + b) for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in encoder.costs and (i, a + b) not in skipped]
        if not pairs:
            return [x for _, s in parts for x in ([encoder.merges[s]] if s in encoder.merges else encoder.vocabulary.ids_of_unknown(s))]
        _, i, k, pair = min(pairs)
        if key ^ encoder.salts[pair] ^ encoder.places[i % 4096] < encoder.below:
            skipped.add((i, pair))
        else:
            parts[k : k + 2] = [(i, pair)]


def test_dropout_brute_force(docs):
    encoder = merge_dropout.Encoder(load_vocabulary(MODEL_PATH), dropout=0.3)
    chunks = {c for r in docs.limit(60).collect() for c in encoder.vocabulary.chunks(" " + r["text"])} | {" aaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 200}
    for i, c in enumerate(sorted(chunks)):
        assert encoder.encode_chunk(c, i % 4) == merges_by_scan(encoder, c, i % 4)
    chunks = sorted(chunks | {"\0", " \0a", "\U0001F600x\u2581", "q" * merge_dropout.SHORT})
    for v in range(4):
        together = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode_chunks(chunks, v)]
        assert together == [merges_by_scan(encoder, c, v) for c in chunks]


def test_dropout_rate(docs):
    """With rate 1 nothing is merged; with a rate between, some documents' pieces differ from the tokenizer's own."""
    vocabulary = load_vocabulary(MODEL_PATH)
    plain, some, every = (merge_dropout.Encoder(vocabulary, dropout=d) for d in (0.0, 0.1, 1.0))
    text = docs.orderBy(F.desc("n_chars")).first()["text"]
    sizes = [len(e.encode(text, "1")) for e in (plain, some, every)]
    assert sizes[0] < sizes[1] < sizes[2] and some.encode(text, "1") != some.encode(text, "2")
    assert all(merge_dropout.decode(np.frombuffer(e.encode(text, "1"), np.int32).tolist(), vocabulary) == text for e in (plain, some, every))


def test_dropout_is_lossless_and_seeded(docs):
    rows = merge_dropout.op1_merge_dropout(docs).collect()
    assert all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["ids_sha256"] for r in rows} == {r["doc_id"]: r["ids_sha256"] for r in merge_dropout.op1_merge_dropout(docs.repartition(5)).collect()}


def test_round_trip_is_encoding_then_decoding(hard):
    encoded, ids = merge_dropout.encode_texts(hard)
    decoded, back = merge_dropout.decode_texts(encoded, ids)
    apart = sorted(map(str, decoded.select("doc_id", F.col(ids), F.col(back).eqNullSafe(F.col("text"))).toPandas().values.tolist()))
    together = merge_dropout.round_trip(hard)
    assert apart == sorted(map(str, together.select("doc_id", ids, "lossless").toPandas().values.tolist()))


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = line_crf.op5_line_crf_quality(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_site_templates(spark):
    menu = "<div><span>Home</span><span>Shop</span></div>"
    rows = [(i, "http://h.example/x", f"<body>{menu}<div><p>Text number {i} of this page, long enough to stand.</p></div></body>") for i in range(10)]
    got = html_text.op3_site_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Text number {r['page_id']} of this page, long enough to stand." for r in got)


def test_pipeline(spark, docs):
    """Stages against brute force: near copies by all pairs, contamination by all windows, secrets by a loop, a round trip."""
    import corpus_pipeline
    from test_near_copies import firsts, similar

    items = [decontaminate.ascii_lower_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}
    scores = {r["doc_id"]: r["predicted"] for r in line_crf.op5_line_crf_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF).checkpoint()
        assert after.columns == docs.columns
        rows, got = kept.collect(), {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality":
            want = {r["doc_id"] for r in rows if scores[r["doc_id"]]}
        elif name == "near_dedup":
            want = firsts(rows, similar([r["text"] for r in rows]))
        elif name == "decontaminate":
            want = set()
            for r in rows:
                words, hit = decontaminate.ascii_lower_words(r["text"]), set()
                for i in range(len(words)):
                    hit |= {j for n in (13, *{len(w) for w in windows if len(w) < 13}) if tuple(words[i : i + n]) in windows for j in range(i, i + n)}
                if not hit or 20 * len(hit) < len(words):
                    want.add(r["doc_id"])
        else:
            want = {r["doc_id"] for r in rows}
            assert all(got[r["doc_id"]] == r["text"] or "<secret>" in got[r["doc_id"]] for r in rows)
            assert not any(secrets_by_loop(t.replace("<secret>", " ")) for t in got.values())
        assert set(got) == want, name
        kept = after
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(got) and all(r["lossless"] for r in out)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_hard_rows(hard, tmp_path, stage):
    """Nulls, empty, long and repeated texts, clashing names and an empty table pass every stage."""
    import corpus_pipeline

    docs = hard.withColumn("n_chars", F.length("text").cast("long"))
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.select(F.col("doc_id").alias("item_id"), F.lit("some words that occur nowhere").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(hard.sparkSession, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and (stage == 4 or out.columns == docs.columns)
    rows = out.collect()
    if name != "quality":
        assert len(rows) == {"near_dedup": 5}.get(name, len(HARD))
    assert run(hard.sparkSession, docs.where("doc_id = 99"), str(tmp_path)).count() == 0
