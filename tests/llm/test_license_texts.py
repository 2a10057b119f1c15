"""Template automata against enumeration of all their texts; whole licenses, altered and unaltered."""

from itertools import product

from tessera.llm import licenses
from tessera.llm.common import ascii_lower_words

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def test_whole_texts_and_altered_ones(spark):
    two = BSD.format(third="")
    rows = [(1, f"Copyright (c) 2020 X\n{MIT}"), (2, MIT.replace("shall be included", "may be included")), (3, two), (4, BSD.format(third=THIRD)), (5, two.replace("binary form must", "binary form should")), (6, MIT[:300])]
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in licenses.op9_license_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "mit-text" in got[1][0] and got[1][1] == 1.0
    assert got[2] == (["mit"], 0.8) and got[6] == (["mit"], 0.8) and got[5] == (["bsd"], 0.8)
    assert "bsd-2-clause-text" in got[3][0] and "bsd-3-clause-text" not in got[3][0]
    assert "bsd-3-clause-text" in got[4][0] and "bsd-2-clause-text" not in got[4][0] and got[4][1] == 1.0


def language(parts, words, most):
    """All texts of a template of nested lists: a word, ("opt", parts) or ("var", n)."""
    out = [[]]
    for p in parts:
        if isinstance(p, str):
            more = [[p]]
        elif p[0] == "opt":
            more = [[], *language(p[1], words, most)]
        else:
            more = [list(w) for n in range(p[1] + 1) for w in product(words, repeat=n)]
        out = [a + b for a in out for b in more if len(a) + len(b) <= most]
    return out


def marked(parts):
    return " ".join(p if isinstance(p, str) else f"<<optional>> {marked(p[1])} <<end>>" if p[0] == "opt" else f"<<var max={p[1]}>>" for p in parts)


def test_automata_by_enumeration():
    words = ["a", "b", "c"]
    for parts in (["a", ("opt", ["b", ("opt", ["c"]), ("var", 1)]), "c"], ["a", ("var", 2), "b"], ["a", ("opt", ["b"]), ("opt", ["b", "c"]), ("var", 2), "a"], ["a", "b", ("opt", [("opt", ["a"]), "c"])]):
        auto = licenses.compile_template("x", marked(parts))
        texts = {tuple(t) for t in language(parts, words, 6)}
        for n in range(1, 7):
            for t in product(words, repeat=n):
                longest = max((k for k in range(1, n + 1) if t[:k] in texts), default=None)
                assert auto.end_of_match([w.encode() for w in t], 0) == longest, (parts, t)


def test_compiled_words_are_the_templates():
    for label, t in (*licenses.TEMPLATES, *licenses.TEXTS):
        assert licenses.compile_template(label, t).anchor.split()[0] == ascii_lower_words(t)[0]
