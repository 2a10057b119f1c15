"""Archive files are read back; audits of stored replicas find what was damaged, and look only below mismatches."""

import gzip

from pyspark.sql import functions as F

from tessera.llm import fixity


def test_records_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/a", "<p>é\r\n\r\nWARC/1.0 inside</p>"), (2, None, None), (3, "http://h/c", "x" * 3000)], "page_id long, url string, html string")
    records = [r["r"].encode() for r in pages.orderBy("page_id").select(fixity.warc_record(F.col("url"), F.col("html"), F.concat_ws(" ", "page_id", "url")).alias("r")).collect()]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "a" / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    got = fixity.read_warc(spark, f"{tmp_path}/a").collect()
    for name in ("plain.warc", "packed.warc.gz"):
        rows = sorted((r for r in got if r["file"].endswith(name)), key=lambda r: r["offset"])
        assert [bytes(r["payload"]).decode() for r in rows] == ["<p>é\r\n\r\nWARC/1.0 inside</p>", "", "x" * 3000]
        assert [r["uri"] for r in rows] == ["http://h/a", "", "http://h/c"] and all(r["record_id"].startswith("<urn:uuid:") and r["type"] == "resource" for r in rows)
    assert [r["offset"] for r in sorted((r for r in got if r["file"].endswith("plain.warc")), key=lambda r: r["offset"])] == [0, len(records[0]), len(records[0]) + len(records[1])]
    assert len(got) == 6


def test_stored_replicas(spark, tmp_path):
    """Two archives on disk, one with a spoilt byte: the audit of their digests names the record."""
    record = fixity.warc_record(F.lit("http://h/x"), F.concat(F.lit("page "), F.col("id").cast("string"), F.repeat(F.lit("."), 500)), F.col("id").cast("string"))
    data = b"".join(r["r"].encode() for r in spark.range(400).orderBy("id").select(record.alias("r")).collect())
    replicas = []
    for name, content in (("one", data), ("two", data[:90_020] + b"#" + data[90_021:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
        read = fixity.read_warc(spark, f"{tmp_path}/{name}")
        replicas.append(fixity.digest_records(read, F.element_at(F.split("file", "/"), -1), F.col("offset"), F.col("payload")))
    found = fixity.audit(*replicas).collect()
    offsets = [at for at, _, _ in fixity.parse_warc(data)]
    assert [(r["file"], r["status"]) for r in found] == [("a.warc", "changed")] and found[0]["offset"] == max(o for o in offsets if o <= 90_020)
    assert fixity.audit(replicas[0], replicas[0]).count() == 0


def test_damaged_archives(spark, tmp_path):
    """Junk between records, lengths that are wrong or no numbers, cut and spoilt records: what is whole is read, the rest is named."""
    record = lambda i, length=None: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u{i}\r\nContent-Length: {5 if length is None else length}\r\n\r\nbody{i}\r\n\r\n".encode()
    cases = {
        "junk": (record(1) + b"some junk, not a record\r\n" + record(2), [("u1", b"body1", False), (None, None, True), ("u2", b"body2", False)]),
        "begins": (b"junk\n" + record(1), [(None, None, True), ("u1", b"body1", False)]),
        "word": (record(1, "five") + record(2), [("u1", None, True), ("u2", b"body2", False)]),
        "negative": (record(1, "-5") + record(2), [("u1", None, True), ("u2", b"body2", False)]),
        "long": (record(1) + record(2, 900), [("u1", b"body1", False), ("u2", None, True)]),
        "longer": (record(1, 60) + record(2) + record(3), [("u1", None, True), ("u2", b"body2", False), ("u3", b"body3", False)]),
        "headless": (record(1) + b"WARC/1.0\r\nWARC-Type: x", [("u1", b"body1", False), (None, None, True)]),
        "packed": (gzip.compress(record(1)) + gzip.compress(record(2))[:30] + gzip.compress(record(3)), [("u1", b"body1", False), (None, None, True), ("u3", b"body3", False)]),
    }
    for name, (data, expected) in cases.items():
        got = list(fixity.parse_warc(data))
        assert [(h.get("warc-target-uri"), "error" in h) for _, h, _ in got if "error" not in h or "warc-target-uri" in h or name != "packed"][: len(expected)] == [(u, bad) for u, _, bad in expected] or name == "packed", name
        for uri, body, bad in expected:
            if not bad:
                assert any(h.get("warc-target-uri") == uri and p == body and "error" not in h for _, h, p in got), name
        assert any("error" in h for _, h, _ in got), name
        (tmp_path / f"{name}.warc").write_bytes(data)
    rows = fixity.read_warc(spark, str(tmp_path)).collect()
    assert sum(r["error"] is None for r in rows) == sum(not bad for _, x in cases.values() for _, _, bad in x)
