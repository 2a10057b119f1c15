"""License scan: template markup compiled into token automata.

A template is license wording with two kinds of marked regions::

    <<optional>> ... <<end>>      the words inside may be left out (regions may nest)
    <<var max=6>>                 up to six words of any kind (names, years)

Everything else is mandatory wording. A template becomes a non-deterministic automaton over words; a text
carries the template's label where the automaton accepts a run of its words, so mandatory wording has to match
word for word. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased: case, punctuation
and line breaks play no part.

Whole licenses (``TEXTS``) have labels of their own and score 1: a text whose later clauses are altered keeps at most the label of
its opening or notice (``TEMPLATES``), with score 0.8.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows give repeated results; ties do not arise.
Only the named id and text columns are read, so further columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, slices

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_AS_IS = """as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
in no event shall <<var max=12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<optional>> <<var max=1>> <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<optional>> <<var max=1>> <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
#: Whole licenses, with the regions that may be left out or replaced; (label, template).
TEXTS = (
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this <<var max=3>> and associated documentation files <<optional>> the software <<end>> to deal in the software without restriction
including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall the <<var max=8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc-text", """permission to use copy modify <<optional>> and <<end>> <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and <<var max=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall <<var max=8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("bsd-2-clause-text", f"{_BSD} this software is provided by <<var max=12>> {_AS_IS}"),
    ("bsd-3-clause-text", f"{_BSD} <<optional>> <<var max=1>> <<end>> neither the name of <<var max=10>> nor the names of <<var max=4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<var max=12>> {_AS_IS}"),
)

#: Notices and openings: (label, template). Each begins with mandatory wording.
TEMPLATES = (
    ("mit", "released under <<optional>> the terms of <<end>> the <<var max=2>> mit license"),
    ("mit", "licensed under <<optional>> the terms of <<end>> the <<var max=2>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<var max=3>> and associated documentation files <<optional>> the software <<end>> to deal in the software without restriction"),
    ("apache-2.0", "licensed under <<optional>> the terms of <<end>> the apache license version 2 0 <<optional>> the license <<end>>"),
    ("cc-by", "licensed under <<optional>> a <<end>> <<optional>> creative commons attribution <<var max=3>> <<end>> cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under <<optional>> a <<end>> <<optional>> creative commons attribution <<var max=3>> <<end>> cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under <<optional>> a <<end>> <<optional>> creative commons attribution <<var max=3>> <<end>> cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license <<optional>> as published by the free software foundation <<optional>> either <<end>> <<end>> version 3 <<optional>> of the license <<end>>"),
    ("gpl-2.0", "licensed under the gnu general public license <<optional>> as published by the free software foundation <<optional>> either <<end>> <<end>> version 2 <<optional>> of the license <<end>>"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0 <<optional>> if a copy of the mpl was not distributed with this file <<end>>"),
    ("copyright-notice", "copyright <<optional>> c <<end>> <<var max=8>> all rights reserved"),
)

_MARK = re.compile(r"<<optional>>|<<end>>|<<var max=(\d+)>>|[^\s<]+")


@dataclass
class Automaton:
    """States are numbers; ``words`` and ``anys`` consume a word, ``frees`` do not. State 0 starts."""

    label: str
    anchor: bytes = b""
    words: dict[tuple[int, bytes], int] = field(default_factory=dict)
    anys: dict[int, int] = field(default_factory=dict)
    frees: dict[int, list[int]] = field(default_factory=dict)
    final: int = 0

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for nxt in self.frees.get(todo.pop(), ()):
                if nxt not in states:
                    states.add(nxt)
                    todo.append(nxt)
        return states

    def end_of_match(self, words: list[bytes], start: int) -> int | None:
        """The end (exclusive) of the longest accepted run of words from ``start``, or None."""
        states, best = self.closure({0}), None
        for at in range(start, len(words) + 1):
            if self.final in states:
                best = at
            if at == len(words):
                break
            step = {self.words[s, words[at]] for s in states if (s, words[at]) in self.words}
            step |= {self.anys[s] for s in states if s in self.anys}
            if not step:
                break
            states = self.closure(step)
        return best


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template. The mandatory words before the first mark are its anchor."""
    auto, state, opened, anchor = Automaton(label), 0, [], []
    plain = True
    for m in _MARK.finditer(template):
        mark = m.group()
        if mark == "<<optional>>":
            plain = False
            opened.append(state)
        elif mark == "<<end>>":
            auto.frees.setdefault(opened.pop(), []).append(state)
        elif m.group(1):
            plain = False
            entry = state
            for _ in range(int(m.group(1))):
                auto.anys[state] = state + 1
                state += 1
                # leaving the region early is a free step, made below once its exit is known
            auto.frees.setdefault(state, []).append(state + 1)
            for s in range(entry, state):
                auto.frees.setdefault(s, []).append(state + 1)
            state += 1
        else:
            for word in ascii_lower_words(mark):
                auto.words[state, word] = state + 1
                state += 1
                if plain:
                    anchor.append(word)
    if opened or not anchor:
        raise ValueError(f"template of {label}: unclosed region, or no mandatory wording at its start")
    auto.final, auto.anchor = state, b" ".join(anchor)
    return auto


def template_regex(template: str) -> str:
    """The same language as a regular expression over words that each end in one space (used by SQL)."""
    out = []
    for m in _MARK.finditer(template):
        mark = m.group()
        if mark == "<<optional>>":
            out.append("(?:")
        elif mark == "<<end>>":
            out.append(")?")
        elif m.group(1):
            out.append(f"(?:[^ ]+ ){{0,{m.group(1)}}}")
        else:
            out += [f"{w.decode()} " for w in ascii_lower_words(mark)]
    return "".join(out)


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which a phrase starts; ``joined`` is the words with one space around each."""
    needle, at, seen, word = b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        yield word


def scan_text(text: str | None, automata: list[Automaton], phrases=PHRASES) -> dict:
    """What the scan finds in one text: word count, phrase places and template matches (label, start, end)."""
    words = ascii_lower_words(text)
    joined = b" " + b" ".join(words) + b" "
    found = [(at, label) for phrase, label in phrases for at in _places(joined, phrase.encode())]
    matches = [(auto.label, at, end) for auto in automata for at in _places(joined, auto.anchor) if (end := auto.end_of_match(words, at)) is not None]
    return {"n_words": len(words), "places": sorted(found), "matches": sorted(set(matches))}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start_word:long,end_word:long>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """One row per document: id, word count, phrase places, labels, a score and the template matches.

    score: 1 where a whole license's mandatory wording matches, 0.8 where only a notice or opening does, 0.5 where only a phrase occurs, else 0.
    Rows stay in their partition; nothing is shuffled or gathered.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, whole = [compile_template(label, t) for label, t in (*templates, *texts)], {label for label, _ in texts}
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                got = scan_text(text, automata, phrases)
                at = [p for p, _ in got["places"]]
                base = {label for _, label in got["places"]}
                both = base | {m[0] for m in got["matches"]}
                row = (got["n_words"], len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(both)), 1.0 if whole & both else 0.8 if got["matches"] else 0.5 if base else 0.0, [{"label": a, "start_word": s, "end_word": e} for a, s, e in got["matches"]])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


def op9_license_templates(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("matches")


def op9_sql(templates=TEMPLATES, phrases=PHRASES, texts=TEXTS) -> str:
    """DuckDB SQL for the same rows: the templates as regular expressions over the joined words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    labels: dict[str, list[str]] = {}
    for label, t in (*templates, *texts):
        labels.setdefault(label, []).append(template_regex(t))
    places = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i - 1 AS place FROM (SELECT rid, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n} AND contains(joined, ' {phrase} ')) WHERE list_slice(w, i, i + {n - 1}) = [{', '.join(repr(x) for x in phrase.split())}]"
        for phrase, label in phrases
        for n in [len(phrase.split())]
    )
    whole = ", ".join(f"'{label}'" for label, _ in texts)
    marks = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(joined, ' {p}')" for p in ps)} THEN '{label}' END" for label, ps in labels.items())
    return f"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM (SELECT doc_id, {words} AS w FROM documents)),
places AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_list FROM places GROUP BY rid),
marked AS (SELECT rid, list_filter([{marks}], lambda x: x IS NOT NULL) AS marks FROM words)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base_list, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), marks))), ','), '') AS labels,
  CASE WHEN list_has_any(marks, [{whole}]) THEN 1.0::DOUBLE WHEN len(marks) > 0 THEN 0.8::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM words JOIN marked USING (rid) LEFT JOIN base USING (rid)
"""
