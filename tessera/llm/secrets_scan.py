"""Secret scan with a randomness test battery, in DataFrame functions only.

Known shapes (an assignment to a secret-like name, an access key, a run of hexadecimal digits) are found by pattern. The
battery looks at all tokens: runs of 16 or more of ``A-Za-z0-9+/_-`` with two of lower case, upper case and digits,
whether or not a known shape covers them. A token's encoding is inferred (the first of ``ENCODINGS`` that has all its
symbols), and three tests ask whether it could be uniform over that alphabet:

* chi-squared uniformity of its symbols,
* runs above and below the alphabet's middle,
* serial correlation of neighbouring symbols.

Fisher's method joins the three; a token is random-looking unless the joint p-value is under ``reject``. Looking random
is weak evidence for a short token, so a second p-value asks how likely word-like text (identifiers, paths, long words)
of that length would look so random, by the same three views: so few equal symbols (words repeat letters), so many
changes of case and digits, so few turns between vowels and consonants; and, in a hexadecimal token, letters up to f only.
Each is bounded by Chernoff's inequality, which gives longer tokens smaller p-values, and Fisher's method joins them.
The Benjamini-Hochberg rule then bounds the false discoveries among reported tokens at ``rate``, within strata of token
length (by powers of two). The rule runs over the whole table: p-values are counted on a grid of tenths of a decade,
rounded up, so what is gathered is at most 31 strata of 400 cells.

Spans are in code points with the end excluded. Discovered tokens have the kind ``random``; they confirm a known shape
where one covers them. Work is linear in a text: places come from sums over blocks of matches (``running``), never
from a list that grows match by match.

Defined results: null and empty texts have no spans; ties and repeated rows repeat; only the named columns are read, new
columns whose name is taken get underscores before it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import bound, running
from .common import fresh_name

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest runs count; shorter ones fail whole, since a run has no later start within it that is longer.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: A whole token with two of lower case, upper case and digits.
_IN = "[A-Za-z0-9+/_-]"
TOKEN = rf"(?<!{_IN})(?={_IN}{{16}})" + "".join(rf"(?!{one}++(?!{_IN}))" for one in ("[a-z+/_-]", "[A-Z+/_-]", "[0-9+/_-]")) + rf"{_IN}{{16,}}+"

KINDS = ("assign", "access", "hex", "random")
REJECT, RATE = 0.01, 0.01
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by name, the narrowest first: their symbols, in order.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base58": "".join(c for c in _DIGITS + _UPPER + _LOWER if c not in "0OIl"),
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
#: Word-like text: how often two symbols agree, a part (a word, a number) begins, neighbouring letters turn between vowel and
#: consonant, a letter is at most f. So set that of 6,000 identifiers, paths and names 1.4 % have a p-value under 0.01.
AGREE, PARTS, TURNS, UP_TO_F = 0.075, 0.12, 0.62, 0.30
GRID, CELLS = 10, 400


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, from, to, match) of every leftmost non-overlapping match, in code points and in bytes.

    What lies between matches gives their places.
    """
    none = F.expr("array()").cast("array<struct<start:int,end:int,from:int,to:int,match:string>>")

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("match"), F.length(gap).alias("gap"), F.length(m).alias("size"), F.octet_length(gap).alias("gap_bytes"), F.octet_length(m).alias("bytes")))

        def put(steps: Column) -> Column:
            points = running(F.transform(steps, lambda x: x["gap"] + x["size"]), _plus, F.lit(0))
            octets = running(F.transform(steps, lambda x: x["gap_bytes"] + x["bytes"]), _plus, F.lit(0))
            both = F.zip_with(points, octets, lambda p, o: F.struct(p.alias("p"), o.alias("o")))
            return F.zip_with(steps, both, lambda x, at: F.struct((at["p"] + x["gap"]).alias("start"), (at["p"] + x["gap"] + x["size"]).alias("end"), (at["o"] + x["gap_bytes"]).alias("from"), (at["o"] + x["gap_bytes"] + x["bytes"]).alias("to"), x["match"].alias("match")))

        return F.when(F.size(found) > 0, bound(steps, put)).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def upper_tail(z: Column) -> Column:
    """P(normal > z), by a rational approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def _share_bound(hits: Column, of: Column, expected: float, more: bool) -> Column:
    """Chernoff's bound, as a negative logarithm, of so many (more) or so few hits of independent trials."""
    share = F.when(of > 0, hits / F.nullif(of, F.lit(0.0))).otherwise(expected)
    beyond = share > expected if more else share < expected

    def part(x: Column, p: float) -> Column:
        return F.when(x > 0, x * F.ln(F.greatest(x, F.lit(1e-12)) / p)).otherwise(0.0)

    return F.when(beyond, of * (part(share, expected) + part(1 - share, 1 - expected))).otherwise(0.0)


def _fisher(total: Column, terms: int) -> Column:
    """The joint p-value of tests whose negative logarithms add up to ``total``."""
    out, term = F.lit(1.0), F.lit(1.0)
    for i in range(1, terms):
        term = term * total / i
        out = out + term
    return F.least(F.lit(1.0), F.exp(-total) * out)


def _tested(tokens: Column) -> Column:
    """The tokens with their joint p-value of uniformity and the grid cell of their p-value as word-like text."""

    def of_encoding(name: Column, values: list) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in zip(ENCODINGS, values, strict=True) for x in pair)), name)

    def named(t):
        kind = F.lit("mixed")
        for name, symbols in reversed(ENCODINGS.items()):
            kind = F.when(F.translate(t["match"], symbols, "") == "", F.lit(name)).otherwise(kind)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["from"].alias("from"), t["to"].alias("to"), t["match"].alias("s"), kind.alias("kind"))

    def indexed(t):
        return F.struct(
            *(t[c].alias(c) for c in ("start", "end", "from", "to", "s", "kind")), F.length(t["s"]).cast("double").alias("n"),
            bound(of_encoding(t["kind"], list(ENCODINGS.values())), lambda a: F.transform(F.split(t["s"], ""), lambda c: F.call_function("instr", a, c).cast("double"))).alias("x"),
            of_encoding(t["kind"], [float(len(a)) for a in ENCODINGS.values()]).alias("k"),
        )

    def counted(t):
        def total(a):
            return F.aggregate(a, F.lit(0.0), lambda so, y: so + y)

        pairs = F.zip_with(F.slice(t["x"], 1, F.size(t["x"]) - 1), F.slice(t["x"], 2, F.size(t["x"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        spread = bound(total(t["x"]) / t["n"], lambda mean: F.struct(
            total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))).alias("lagged"), total(F.transform(t["x"], lambda y: (y - mean) * (y - mean))).alias("spread")))
        letters = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t["s"]), "[^a-z]", "."), "[aeiou]", "0"), "[b-z]", "1")
        # a 2 and a 3 between neighbouring letters: alike, and a turn
        between = F.regexp_replace(F.regexp_replace(letters, "(?<=0)(?=0)|(?<=1)(?=1)", "2"), "(?<=0)(?=1)|(?<=1)(?=0)", "3")
        return F.struct(
            *(t[c].alias(c) for c in ("start", "end", "from", "to", "kind", "n", "k")), spread["lagged"].alias("lagged"), spread["spread"].alias("spread"),
            total(F.transform(F.array_distinct(t["x"]), lambda v: F.pow(F.size(F.filter(t["x"], lambda y: y == v)).cast("double"), 2.0))).alias("squares"),
            F.size(F.filter(t["x"], lambda y: y > t["k"] / 2)).cast("double").alias("above"),
            (1 + F.size(F.filter(pairs, lambda p: (p["a"] > t["k"] / 2) != (p["b"] > t["k"] / 2)))).cast("double").alias("runs"),
            F.size(F.regexp_extract_all(t["s"], F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))).cast("double").alias("parts"),
            F.length(F.regexp_replace(t["s"], "[^A-Za-z0-9]", "")).cast("double").alias("plain"), F.length(F.regexp_replace(t["s"], "[^A-Za-z]", "")).cast("double").alias("letters"),
            F.length(F.regexp_replace(between, "[^3]", "")).cast("double").alias("turns"), F.length(F.regexp_replace(between, "[^23]", "")).cast("double").alias("neighbours"),
        )

    def scored(t):
        n, k = t["n"], t["k"]
        chi = k * t["squares"] / n - n
        expected_runs = 1 + 2 * t["above"] * (n - t["above"]) / n
        runs_var = (expected_runs - 1) * (expected_runs - 2) / (n - 1)
        equal, usual = (t["squares"] - n) / 2, n * (n - 1) / 2 * AGREE
        few = F.when(equal < usual, usual - equal + F.when(equal > 0, equal * F.ln(F.greatest(equal, F.lit(1e-12)) / usual)).otherwise(0.0)).otherwise(0.0)
        wordy = few + _share_bound(t["parts"], t["plain"], PARTS, True) + _share_bound(t["turns"], t["neighbours"], TURNS, False)
        narrow = F.when(t["kind"].isin("hex", "hex_upper"), -t["letters"] * F.ln(F.lit(UP_TO_F)))
        return F.struct(
            *(t[c].alias(c) for c in ("start", "end", "from", "to", "n")),
            upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("p_chi"),
            F.when(runs_var > 0, 2 * upper_tail(F.abs(t["runs"] - expected_runs) / F.sqrt(runs_var))).otherwise(0.0).alias("p_runs"),
            F.when(t["spread"] > 0, 2 * upper_tail(F.abs(t["lagged"] / F.nullif(t["spread"], F.lit(0.0)) * F.sqrt(n - 1) + 1 / F.sqrt(n - 1)))).otherwise(0.0).alias("p_serial"),
            F.when(narrow.isNull(), _fisher(wordy, 3)).otherwise(_fisher(wordy + F.coalesce(narrow, F.lit(0.0)), 4)).alias("p_word"),
        )

    def joined(t):
        total = sum((-F.ln(F.greatest(t[p], F.lit(1e-300))) for p in ("p_chi", "p_runs", "p_serial")), F.lit(0.0))
        return F.struct(
            *(t[c].alias(c) for c in ("start", "end", "from", "to", "p_word")), F.floor(F.log2(t["n"])).cast("int").alias("stratum"), _fisher(total, 3).alias("p_random"),
            F.least(F.lit(CELLS), F.floor(-F.log10(F.greatest(t["p_word"], F.lit(1e-300))) * GRID)).cast("int").alias("cell"),
        )

    for step in (named, indexed, counted, scored, joined):
        tokens = F.transform(tokens, step)
    return tokens


def discovery_cells(docs: DataFrame, text_col: str = "text", reject: float = REJECT, rate: float = RATE) -> dict[int, int]:
    """By length stratum, the least cell that the Benjamini-Hochberg rule accepts (strata without one are left out).

    Tokens that the battery rejects stay tests of the stratum, with a p-value of 1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = docs.select(text.alias("text")).where(F.col("text").rlike(TOKEN)).select(F.explode(_tested(_matches(F.col("text"), TOKEN))).alias("t")).select("t.stratum", F.when(F.col("t.p_random") >= reject, F.col("t.cell")).otherwise(0).alias("cell"))
    counts = tokens.groupBy("stratum", "cell").agg(F.count("*").alias("n"))  # at most 31 x 401 rows from here on
    stratum = Window.partitionBy("stratum")
    ruled = counts.withColumn("m", F.sum("n").over(stratum)).withColumn("found", F.sum("n").over(stratum.orderBy(F.desc("cell"))))
    accepted = ruled.where(F.pow(F.lit(10.0), -F.col("cell") / GRID) <= rate * F.col("found") / F.col("m")).groupBy("stratum").agg(F.min("cell").alias("cell"))
    return {r["stratum"]: r["cell"] for r in accepted.collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", reject: float = REJECT, rate: float = RATE) -> tuple[DataFrame, str]:
    """The rows with ``array<struct<start,end,kind>>`` of all spans, by start and kind; also returns the column's name.

    kind is the number of the span's kind in KINDS. The table is read twice: once for the discovery rule.
    """
    cells = discovery_cells(docs, text_col, reject, rate)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def spans(found, kind):
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to")))

    assigned = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 12)
    parts = [spans(assigned, "assign"), spans(_matches(text, ACCESS), "access"), spans(_matches(text, HEX), "hex")]
    if cells:
        least = F.create_map(*(F.lit(x) for pair in cells.items() for x in pair))
        parts.append(spans(F.filter(_tested(_matches(text, TOKEN)), lambda t: (t["p_random"] >= reject) & (t["cell"] >= F.coalesce(F.try_element_at(least, t["stratum"]), F.lit(CELLS + 1)))), "random"))
    name = fresh_name(docs, "spans")
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.array_sort(F.concat(*parts)).alias(name)), name


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "<secret>", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents with every span replaced by ``mask`` (overlapping spans by one); a length column is brought up to date.

    Rows without spans come back as they were. Texts are cut by byte, so that a cut does not count from the text's start.
    """
    found, spans = find_secrets(docs, text_col, **options)
    text = F.col(f"`{text_col}`")

    def cut(so_far: Column) -> Column:
        """so_far: where the spans before each span end."""

        def pieces(data: Column) -> Column:
            each = F.zip_with(F.col(spans), so_far, lambda s, at: F.when(s["from"] >= at, F.concat(F.substring(data, at + 1, s["from"] - at).cast("string"), F.lit(mask))).otherwise(""))
            last = F.array_max(F.transform(F.col(spans), lambda s: s["to"]))
            return F.concat(F.array_join(each, ""), F.substring(data, last + 1, F.octet_length(data)).cast("string"))

        return bound(text.cast("binary"), pieces)

    done = bound(running(F.transform(F.col(spans), lambda s: s["to"]), lambda x, y: F.greatest(x, y), F.lit(0)), cut)
    clean = found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))
    if length_col and length_col in docs.columns:
        clean = clean.withColumn(length_col, F.when(F.size(spans) > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`")))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_randomness_battery(docs: DataFrame) -> DataFrame:
    """Per document: spans by kind, a digest of those of known shapes, all spans, and how many the battery discovered."""
    found, spans = find_secrets(docs.select("doc_id", "text"))

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    def written(of):
        return F.array_join(F.transform(of, lambda s: F.concat(F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(written(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), written(F.col(spans)).alias("spans"), number("random").alias("n_random"))
