"""Coloured lines against Python's own tokens."""

import io
import keyword
import tokenize
from pathlib import Path

import pytest

from codeloom.functions import highlight

ROOT = Path(__file__).resolve().parent.parent
HARD = [
    'x = """one\n two \'\'\' " three\\"""\n still """ + 1  # end\ny = 2\n',
    "a = 'one \\\n two' + \"three \\\\\" # 'c'\nb = r'\\'' rb\"x\"\n",
    "'''\n'''\n''''''\n\"\"\"'''\n\"\"\"\n'' ''\n",
    "n = 0x_ff + 1_0.5e-3j + .5 + 0b1 + 0o7 + 1.\nclass é: pass\nif x is not None: return_ = ifx\n",
    "s = 'a\\\n'' b'\nt = 1\n",
    "q = '\\\n' + '''\\''' '''\nrest = 3\n",
    "x = '''" + "\n".join(["line 'of' \"it\" # no"] * 700) + "''' # yes\nz = 4\n",
    "long = '" + "ab\\'" * 20_000 + "'\n" + "y" * 50_000 + " = 1\n",
]


def by_python(source):
    """(line, kind, text) of each part of a token in a line, strings split at line ends, as tokenize sees them."""
    out = []
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        kind = {tokenize.NAME: "keyword" if keyword.iskeyword(t.string) else "name", tokenize.STRING: "string", tokenize.COMMENT: "comment", tokenize.NUMBER: "number"}.get(t.type)
        if kind:
            out += [(t.start[0] + n, kind, part) for n, part in enumerate(t.string.split("\n")) if part]
    return out


@pytest.fixture(scope="module")
def sources():
    own = [p.read_text() for p in sorted((ROOT / "codeloom").rglob("*.py")) if "llm" not in p.parts]
    plain = [s for s in own if not any(t.type == tokenize.FSTRING_START for t in tokenize.generate_tokens(io.StringIO(s).readline))]
    assert len(plain) > 8
    return [*HARD, *plain]


def test_spans_are_pythons(spark, sources):
    rows = highlight.token_spans(spark.createDataFrame(list(enumerate(sources)), "k long, text string").repartition(3), "k", "text").where("kind != 'sign'").collect()
    for k, source in enumerate(sources):
        mine = [(r.line_number, r.kind, r.text) for r in sorted(rows, key=lambda r: (r.line_number, r.place)) if r.k == k]
        assert mine == by_python(source), source[:80]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_states_do_not_depend_on_blocks(spark, block):
    df = spark.createDataFrame(list(enumerate(HARD[:6])), "k long, text string")
    assert sorted(highlight.line_states(df, "k", "text", block).collect()) == sorted(highlight.line_states(df, "k", "text", 2).collect())


def test_coloured_lines(spark):
    df = spark.createDataFrame([(1, "def f(): # <x>\n return '&'\n"), (None, None), (None, "'''a\nb"), (2, ""), (1, "x"), (None, "'''a\nb")], "k long, text string")
    rows = sorted(map(tuple, highlight.coloured_lines(df, "k", "text").collect()), key=str)
    assert rows == sorted([
        (1, 1, '<span id="line-1"><span class="k">def</span> f(): <span class="c"># &lt;x&gt;</span></span>'),
        (1, 2, '<span id="line-2"> <span class="k">return</span> <span class="s">&#039;&amp;&#039;</span></span>'),
        (1, 1, '<span id="line-1">x</span>'),
        *[(None, 1, '<span id="line-1"><span class="s">&#039;&#039;&#039;a</span></span>'), (None, 2, '<span id="line-2"><span class="s">b</span></span>')] * 2,
    ], key=str)
    assert highlight.coloured_lines(df.limit(0), "k", "text").isEmpty()
