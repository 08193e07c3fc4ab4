from __future__ import annotations

import pytest

from forgelens.llm import grammar, handwritten, jsgrammar

from ..conftest import rows

GOOD = [
    "", "a=>a", "(a,b)=>{return a+b}", "async x=>await x", "({a=1})=>a", "({a,b=2}=c)", "for (const x of y) z(x)", "for(;;){break}", "x=a/b/c; y=/re[/]/g.test(s)", "`a${b}c${`n${d}`}`",
    "class A extends B{#p=1; static x; static {this.y=1} constructor(){super()} get z(){return this.#p} async *m(){} }", "l: for(;;){break l}", "a?.b?.[c]?.(d)", "var a=1\nvar b=2", "n=w=>w?w.h:void 0;",
    "(()=>{var e={1:(e,t,n)=>{n.d(t,{table:()=>o})}};function n(r){return t[r]||(t[r]={})}n(6)})()", "label: { break label }", "{ let x } { let x }", "throw new Error(`x`)", "x = a ** -b", "import('x').then(y)", "if (a) function g(){}", "#!/bin/node\n1", "let async; async()",
]
BAD = [
    "a b", "for(;;", "{", "}", "function(){}", "x = = 1", "'abc", "`abc", "return 1", "break", "import x from 'y'", "export default 1", "let a; let a", "const a", "({a=1})", "class {}", "1=2", "def f(x):", "<<<<<<< ours", "a ?? b || c", "-a ** b",
    "/abc", "new.target", "{\"a\": 1, \"b\": 2}", "x: x: y", "\"use strict\"; with(a){}", "0123n", "else {}", "a?.b = 1", "let x; var x", "()", "super.x", "async function f(){ function g(){ await x } }", "“x”",
]


@pytest.mark.parametrize("text", GOOD)
def test_scripts(text):
    jsgrammar.check(text)


@pytest.mark.parametrize("text", BAD)
def test_no_scripts(text):
    with pytest.raises(jsgrammar.JsSyntaxError):
        jsgrammar.check(text)


@pytest.mark.parametrize(("text", "language", "expected"), [
    ("x = 1\n", "python", ("valid", "python")), ("", "python", ("valid", "python")), ("", "json", ("corrupt", None)), ("{\"a\": NaN}", "json", ("corrupt", None)), ("{\"a\": 1,}", "json", ("corrupt", None)),
    ("{\"a\": [1, 2]}", "python", ("valid", "python")), ("print 'x'\n", "python", ("corrupt", None)), ("def f(:\n", "python", ("corrupt", None)), ("const a = (b) => { return b };\n", "python", ("wrong_extension", "javascript")),
    ("import os\n\ndef f():\n    pass\n", "javascript", ("wrong_extension", "python")), ("[a]\nb = 1\n", "json", ("wrong_extension", "toml")), ("a = 1\na = 2\n", "toml", ("corrupt", None)), ("﻿x = 1", "python", ("valid", "python")),
    ("x = undefined_name\nreturn_ = 1", "python", ("valid", "python")), ("def f(a, a): pass", "python", ("valid", "python")), ("x = '\0'", "python", ("corrupt", None)), ("9" * 5000, "json", ("valid", "json")),
])
def test_verdicts(text, language, expected):
    assert grammar.verdict(text, language) == expected


def test_every_grammar_is_tried():
    assert grammar.judged('{"a": 1, "b": [1, 2]}', "python") == ("valid", "python", ["python", "json"]) or set(grammar.judged('{"a": 1, "b": [1, 2]}', "python")[2]) == {"python", "json"}
    assert set(grammar.judged('[tool]\nname = "x"\n', "python")[2]) == {"toml", "python", "javascript"}
    assert grammar.judged("def f(:", "python") == ("corrupt", None, [])


def test_deep_nesting_is_undecided(spark):
    assert grammar.verdict("[" * 200_000 + "]" * 200_000, "json")[0] == "undecided"


def test_flags_and_rates(spark):
    df = spark.createDataFrame([(1, "p", "a.py", "x ="), (2, "p", "b.py", "x = 1"), (3, "q", "c.json", "{"), (4, None, "d.txt", "x ="), (5, "p", "e.py", None), (1, "p", "a.py", "x ="), (6, "p", None, "x")], "file_id long, project_name string, file_path string, content string")
    assert rows(grammar.flagged(df), "file_id") == [(1,), (1,), (3,)]
    assert rows(grammar.rates(df), "project_name", "language", "files", "flagged") == [("p", "python", 3, 2), ("q", "json", 1, 1)]
    assert grammar.flagged(df.limit(0)).count() == 0


def code(seed, n=40):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda_ mu nu".split()
    return "import os\n\n\n" + "".join(f"def {words[(i * seed) % 13]}_{words[(i + seed) % 13]}{seed}(arg):\n    value = arg.{words[(i * 3 + seed) % 13]} + {i * seed}\n    return value\n\n\n" for i in range(n))


@pytest.mark.parametrize(("text", "made"), [
    ("# Code generated by x. DO NOT EDIT.\nx = 1\n", True), ("# Bu dosya x tarafindan otomatik oluşturuldu, elle değiştirmeyin.\nx = 1\n", True), ('"""Automatically created by x."""\nx = 1\n', True), ("/* Written by x on every build; local edits disappear. */\nlet a", True),
    ("# first generated by x,\n# then rewritten by hand in 2020; please edit it here.\nx = 1\n", False), ('import sys\nHEADER = "# Code generated by this script. DO NOT EDIT."\n', False), ("x = 1  # do not edit\n", False), ("", False),
])
def test_notices(text, made):
    assert handwritten.notices(text)[0] is made


def test_shapes():
    assert handwritten.shape(";".join(f"var {c}=function(a){{return a[{i}]^{i}}}" for i, c in enumerate("abcdefghijklmnop")), True) == "minified"
    assert handwritten.shape("T = [\n" + "".join(f"    0x{i:02x}, 0x{i + 1:02x},\n" for i in range(80)) + "]\n", False) == "data"
    assert handwritten.shape("class C:\n" + "".join(f"    def call_{i}(self, a):\n        return self.c('/x/{i}', a)\n" for i in range(20)), False) == "numbered"
    assert handwritten.shape(code(3), False) is None
    assert handwritten.shape("LIMITS = [\n" + "".join(f"    ('name', {i}),  # why this one\n" for i in range(40)) + "]\n", False) is None


def test_sentences_as_data_and_notices_below_a_long_licence():
    sentences = "TEXTS = [\n" + "".join(f'    "if you return for item {i}, import it for the rest",\n' for i in range(60)) + "]\n"
    assert handwritten.shape(sentences, False) == "data"
    licence = "".join(f"# clause {i} of the licence\n" for i in range(90))
    assert handwritten.notices(licence + "# Code generated by x. DO NOT EDIT.\nx = 1\n")[0]


def test_copies_and_paths(spark):
    lib, other = code(5), code(7)
    near = lib.replace("value = arg.alpha", "value = arg.omega", 1)
    files = [
        (1, "a/a", "src/lib.py", lib), (2, "b/b", "app/x.py", near), (3, "c/c", "app/y.py", other), (4, "C/C ", "app/y.py", other), (5, "d/d", "setup.py", "from setuptools import setup\n\nsetup()\n"), (6, "e/e", "setup.py", "from setuptools import setup\n\nsetup()\n"),
        (7, "f/f", "x/node_modules/z.py", "y = 1\n"), (8, "f/f", "vendor/own.py", code(11)), (9, "g/g", "lib/data.txt", lib), (10, "g/g", "n.py", None), (11, None, "m.js", ""),
    ]
    df = spark.createDataFrame(files, "file_id long, project_name string, file_path string, content string")
    assert rows(handwritten.not_handwritten(df), "file_id", "reason") == [(1, "copy"), (2, "copy"), (7, "vendored")]
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_variants_of_one_project_meet_the_copy_in_another(spark):
    words = [f"w{i}" for i in range(400)]

    def variant(k):
        w = list(words)
        for i in range(4):
            w[(k * 7 + i * 97) % 400] = f"v{k}_{i}"
        return "\n".join(f"{a} = {b}" for a, b in zip(w[::2], w[1::2])) + "\n"

    files = [(k, "a/a", f"src/m{k}.py", variant(k)) for k in range(60)] + [(100, "b/b", "lib/m.py", "\n".join(f"{a} = {b}" for a, b in zip(words[::2], words[1::2])) + "\n"), (200, "a/a", "src/z.py", code(3)), (201, "a/a", "src/y.py", code(3).replace("value", "other", 2))]
    df = spark.createDataFrame(files, "file_id long, project_name string, file_path string, content string")
    whole = {f[0]: set(handwritten.shingles(f[3]).tolist()) for f in files}
    near = [k for k in range(60) if len(whole[k] & whole[100]) >= handwritten.SIMILARITY * len(whole[k] | whole[100])]
    assert len(near) == 60
    assert [r[0] for r in rows(handwritten.not_handwritten(df), "file_id")] == [*range(60), 100]
