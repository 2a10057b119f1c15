"""Fill-in-middle examples: texts cut at unit boundaries, their middles moved to the end.

Relational: every text is cut into units (runs of letters, single other characters), one row per unit by ``posexplode``; a window
over the units of a text sums their lengths; the cut requests of a text (two unit ordinals, drawn from the hash of its id) are joined by ordinal; the ends found are
aggregated to two offsets per text, and ``substring`` cuts prefix, middle and suffix.

Rows alike in id and text are one text with a number of copies, so a hot group is counted before the one shuffle of texts. Units, requests and
texts are all read from that shuffle: it deals texts by key, in which order the units are made, so that neither unit rows nor offsets are shuffled. Units after a text's last cut
are not made.

Defined results: a null text is empty; a null id hashes like an empty id; empty texts and texts that hold a sentinel stay plain; a cut may fall on either end,
and both cuts on one place; repeated rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import bound

UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of 100: texts with a middle, and of those the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
_KEY = ["key_a", "key_b"]


def unit_count(text: Column) -> Column:
    """Number of units: of what remains when every run of letters becomes one."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def _number(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest, from 0."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def texts_by_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key_a, key_b, id, text, copies), one row per different id and text, dealt and sorted by key: 120 bits of SHA-256 of both."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text), 256)
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest"))
    parts = {name: F.coalesce(F.conv(F.substring("digest", at, 15), 16, 10).cast("long"), F.lit(0)) for name, at in zip(_KEY, (1, 16), strict=True)}
    return keyed.withColumns(parts).groupBy(*_KEY).agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("copies")).where("copies > 0")


def cut_requests(texts: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The texts with n, form, and the ordinals of the units before the first and the second cut (0: none)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = texts.withColumns({"n": unit_count(F.col("text")), "digest": digest}).withColumns({f"h{k + 1}": _number(F.col("digest"), k) for k in range(4)})
    sentinel = F.greatest(*(F.instr("text", s) for s in (PREFIX, SUFFIX, MIDDLE))) > 0
    form = F.when((F.col("n") == 0) | sentinel | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    cut = drawn.withColumns({"form": form, "first_cut": F.least(one, two), "second_cut": F.greatest(one, two)}).drop("digest", "h1", "h2", "h3", "h4")
    return cut.withColumns({c: F.when(F.col("form") != "plain", F.col(c)).otherwise(0) for c in ("first_cut", "second_cut")})


def unit_ends(texts: DataFrame) -> DataFrame:
    """(key, ordinal, end): for each unit before a text's second cut its ordinal from 1 and the characters up to its end."""
    matched = texts.select(*_KEY, "second_cut", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)).alias("units"))
    units = matched.select(*_KEY, F.posexplode(F.slice("units", F.lit(1), F.col("second_cut").cast("int"))).alias("place", "unit"))
    so_far = Window.partitionBy(*_KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = units.select(*_KEY, "place", F.length("unit").alias("length"))
    return lengths.select(*_KEY, (F.col("place") + 1).alias("ordinal"), F.sum("length").over(so_far).alias("end"))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, text, copies, n, form, prefix_chars, middle_chars, output), one row per different id and text."""
    texts = cut_requests(texts_by_key(docs, id_col, text_col), rate, suffix_first)
    requests = texts.select(*_KEY, "first_cut", "second_cut")
    at_cut = unit_ends(texts).join(requests.hint("shuffle_hash"), _KEY).where("ordinal IN (first_cut, second_cut)")
    ends = at_cut.groupBy(*_KEY).agg(*(F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))).alias(name) for c, name in (("first_cut", "first_end"), ("second_cut", "second_end"))))
    cut = texts.join(ends.hint("shuffle_hash"), _KEY, "left")
    made, (first, second) = F.col("form") != "plain", (F.coalesce(c, F.lit(0)) for c in ("first_end", "second_end"))
    placed = cut.withColumns({"prefix_chars": F.when(made, first).cast("long"), "middle_chars": F.when(made, second - first).cast("long")})
    return placed.select("id", "text", "copies", "n", "form", "prefix_chars", "middle_chars", _output(F.col("text"), F.col("form"), F.col("prefix_chars"), F.col("middle_chars")).alias("output"))


def _output(text: Column, form: Column, prefix_chars: Column, middle_chars: Column) -> Column:
    start = prefix_chars.cast("int") + 1
    prefix, middle = F.substring(text, F.lit(1), prefix_chars.cast("int")), F.substring(text, start, middle_chars.cast("int"))
    suffix = F.substring(text, start + middle_chars.cast("int"), F.length(text))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form alone. A cut text holds no sentinel, and none can arise where a part meets one, since each begins with its only ``<``."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)  # the first is empty
    in_order = bound(parts, lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    return F.when(form == "plain", output).otherwise(in_order)


def op12_relational_units(docs: DataFrame) -> DataFrame:
    cut = fill_middle(docs.select("doc_id", "text")).withColumn("restored", restored(F.col("output"), F.col("form")))
    digests = cut.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"), "copies")
    return digests.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def op12_sql() -> str:
    return """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, [('0x' || substr(digest, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM units
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS first_cut, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS second_cut,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, array_to_string(units[:first_cut], '') AS prefix, array_to_string(units[first_cut + 1:second_cut], '') AS middle, array_to_string(units[second_cut + 1:], '') AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM cut
"""
