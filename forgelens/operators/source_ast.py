"""Code metrics, smells and functions of Python sources, as Arrow functions over the syntax tree.

Rejected texts (too long, unparsable, too few source lines) give a null struct of metrics and zero
smells. One bad file never fails a batch. A file is parsed once and every walk is a loop, so neither deep
nor long chained expressions cost more than their nodes. Operands are equal where their trees are, told
by a number per tree given bottom up. Formulas: Halstead with the usual operators and operands,
cyclomatic complexity 1 + decision points, cognitive complexity with nesting increments, and the
maintainability index scaled to 0..100.
"""

from __future__ import annotations

import ast
import io
import math
import tokenize
import warnings
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.session import spread

# Thresholds of the smells and of the quality gate.
MAX_CHARACTERS, MIN_SLOC = 500_000, 10
LONG_METHOD_LOC, LARGE_CLASS_LOC, LARGE_CLASS_METHODS, LONG_PARAMS, NESTING, HIGH_CC, LOW_MI, GOD_CC, GOD_LOC = 50, 500, 10, 5, 4, 10, 20, 15, 80

METRICS = (
    "loc int, lloc int, sloc int, comments int, multi int, blank int, single_comments int, num_functions int, cc_mean double, cc_max double, cc_total double, "
    "h_vocabulary double, h_length double, h_volume double, h_difficulty double, h_effort double, h_bugs double, h_time double, h_calculated_length double, "
    "maintainability_index double, cognitive_complexity_total int, cognitive_complexity_max int"
)
METRIC_NAMES = [x.split()[0] for x in METRICS.split(", ")]
INT_METRICS = frozenset(x.split()[0] for x in METRICS.split(", ") if x.endswith(" int"))
SMELLS = ("smell_long_method", "smell_large_class", "smell_long_param_list", "smell_deep_nesting", "smell_high_complexity", "smell_low_maintainability", "smell_god_function")
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)


Children = Callable[[ast.AST], Iterable[ast.AST]]


def parsed(source: str | None) -> ast.Module | None:
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def complexity(node: ast.AST, children: Children = ast.iter_child_nodes) -> int:
    """1 + decision points, nested functions and classes counted on their own."""
    n, todo = 1, list(children(node))
    while todo:
        x = todo.pop()
        if isinstance(x, (*FUNCTION, ast.ClassDef)):
            continue
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.match_case):
            n += 1
        todo.extend(children(x))
    return n


def cognitive(node: ast.AST, children: Children = ast.iter_child_nodes) -> int:
    """Breaks in the flow, each worth one more per level it lies in; chained ``elif`` and ``else`` worth one."""
    total, todo = 0, [(node, 0)]
    while todo:
        parent, depth = todo.pop()
        for x in children(parent):
            deeper = depth
            if isinstance(x, (ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
                total += 1 + depth
                deeper = depth + 1
            elif isinstance(x, ast.If):
                chained = isinstance(parent, ast.If) and len(parent.orelse) == 1 and parent.orelse[0] is x
                total += 1 if chained else 1 + depth
                if x.orelse and not (len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If)):
                    total += 1
                deeper = depth if chained else depth + 1
            elif isinstance(x, ast.BoolOp):
                total += 1
            elif isinstance(x, (*FUNCTION, ast.Lambda)):
                deeper = depth + 1
            todo.append((x, deeper))
    return total


def nesting(node: ast.AST, children: Children = ast.iter_child_nodes) -> int:
    """Deepest chain of blocks; an ``elif`` nests in its ``if`` and nested functions count."""
    best, todo = 0, [(node, 0)]
    while todo:
        parent, depth = todo.pop()
        best = max(best, depth)
        todo.extend((x, depth + isinstance(x, NESTS)) for x in children(parent))
    return best


def tree_numbers(nodes: list[ast.AST]) -> dict[int, int]:
    """A number per expression node, equal for equal trees; ``nodes`` holds parents before children."""
    seen: dict[tuple, int] = {}
    number: dict[int, int] = {}
    for x in reversed(nodes):
        if not isinstance(x, (ast.expr, ast.comprehension, ast.keyword, ast.arguments, ast.arg)):
            continue
        key: list = [type(x)]
        for name in x._fields:
            v = getattr(x, name, None)
            if isinstance(v, ast.AST):
                key.append(None if isinstance(v, ast.expr_context) else number.get(id(v), type(v)))
            elif isinstance(v, list):
                key.append(tuple(number.get(id(e), type(e)) if isinstance(e, ast.AST) else e for e in v))
            else:
                key.append((type(v), v if isinstance(v, (str, bytes)) else repr(v)))
        number[id(x)] = seen.setdefault(tuple(key), len(seen))
    return number


def halstead(nodes: list[ast.AST]) -> tuple[float, ...]:
    """(vocabulary, length, volume, difficulty, effort, bugs, time, calculated length) of the nodes of a tree, parents first."""
    operators: list[type] = []
    operands: list[ast.AST] = []
    for x in nodes:
        if isinstance(x, ast.BinOp):
            operators.append(type(x.op))
            operands += [x.left, x.right]
        elif isinstance(x, ast.UnaryOp):
            operators.append(type(x.op))
            operands.append(x.operand)
        elif isinstance(x, ast.BoolOp):
            operators += [type(x.op)] * (len(x.values) - 1)
            operands += x.values
        elif isinstance(x, ast.Compare):
            operators += [type(o) for o in x.ops]
            operands += [x.left, *x.comparators]
        elif isinstance(x, ast.AugAssign):
            operators.append(type(x.op))
            operands += [x.target, x.value]
    number = tree_numbers(nodes) if operands else {}
    n1, n2, total1, total2 = len(set(operators)), len({number[id(x)] for x in operands}), len(operators), len(operands)
    vocabulary, length = n1 + n2, total1 + total2
    volume = length * math.log2(vocabulary) if vocabulary else 0.0
    difficulty = n1 / 2 * total2 / n2 if n2 else 0.0
    calculated = (n1 * math.log2(n1) if n1 else 0.0) + (n2 * math.log2(n2) if n2 else 0.0)
    return float(vocabulary), float(length), volume, difficulty, difficulty * volume, volume / 3000, difficulty * volume / 18, calculated


def line_counts(source: str, nodes: list[ast.AST]) -> tuple[int, int, int, int, int, int, int]:
    """(loc, lloc, sloc, comments, multi, blank, single_comments)."""
    lines = source.splitlines()
    comments, only, code = 0, set(), set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                comments += 1
                if lines[t.start[0] - 1].lstrip().startswith("#"):
                    only.add(t.start[0])
            elif t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING):
                code.update(range(t.start[0], t.end[0] + 1))
    except (tokenize.TokenError, IndentationError, IndexError):
        pass
    multi = single = 0
    for x in nodes:
        if isinstance(x, (ast.Module, ast.ClassDef, *FUNCTION)) and x.body and isinstance(x.body[0], ast.Expr) and isinstance(x.body[0].value, ast.Constant) and isinstance(x.body[0].value.value, str):
            span = range(x.body[0].lineno, x.body[0].end_lineno + 1)
            code.difference_update(span)
            if len(span) > 1:
                multi += len(span)
            else:
                single += 1
    blank = sum(not x.strip() for x in lines)
    lloc = sum(isinstance(x, ast.stmt) for x in nodes)
    return len(lines), lloc, len(code), comments, multi, blank, len(only) + single


def maintainability(volume: float, cc: float, sloc: int, share: float) -> float:
    if sloc <= 0 or volume <= 0:
        return 100.0
    return max(0.0, 100 * (171 - 5.2 * math.log(volume) - 0.23 * cc - 16.2 * math.log(sloc) + 50 * math.sin(math.sqrt(2.4 * math.radians(100 * share)))) / 171)


class Analysis(NamedTuple):
    """What one parse of a source tells: metrics (None for a rejected text), smells and functions."""

    metrics: dict | None
    smells: dict[str, int]
    functions: list[dict]


def _no_smells() -> dict[str, int]:
    return {"smell_count": 0} | dict.fromkeys(SMELLS, 0)


def analysed(source: str | None) -> Analysis:
    """Parse once; a text that does not parse has no metrics, no smells and no functions."""
    tree = parsed(source)
    if tree is None:
        return Analysis(None, _no_smells(), [])
    nodes, below = [tree], {}
    for x in nodes:  # grows while it is read
        below[id(x)] = own = list(ast.iter_child_nodes(x))
        nodes.extend(own)
    children = lambda x: below[id(x)]
    found = []
    for x in nodes:
        if isinstance(x, FUNCTION):
            a = x.args
            found.append((x, {"name": x.name, "line": x.lineno, "loc": x.end_lineno - x.lineno + 1, "params": len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg), "nesting": nesting(x, children), "cc": complexity(x, children)}))
    functions = [f for _, f in found]
    cc = [f["cc"] for f in functions]
    loc, lloc, sloc, comments, multi, blank, single = line_counts(source, nodes)
    h = halstead(nodes)
    counts = dict.fromkeys(SMELLS, 0)
    counts["smell_long_method"] = sum(f["loc"] > LONG_METHOD_LOC for f in functions)
    counts["smell_long_param_list"] = sum(f["params"] > LONG_PARAMS for f in functions)
    counts["smell_deep_nesting"] = sum(f["nesting"] > NESTING for f in functions)
    counts["smell_high_complexity"] = sum(f["cc"] > HIGH_CC for f in functions)
    counts["smell_god_function"] = sum(f["cc"] > GOD_CC and f["loc"] > GOD_LOC for f in functions)
    for x in nodes:
        if isinstance(x, ast.ClassDef):
            methods = sum(isinstance(m, FUNCTION) for m in x.body)
            counts["smell_large_class"] += x.end_lineno - x.lineno + 1 > LARGE_CLASS_LOC and methods >= LARGE_CLASS_METHODS
    counts["smell_low_maintainability"] = int(maintainability(h[2], sum(cc) or 1, sloc, comments / max(1, loc)) < LOW_MI)
    measured = None
    if len(source) <= MAX_CHARACTERS and sloc >= MIN_SLOC:
        cog = [cognitive(x, children) for x, _ in found]
        measured = dict(zip(
            METRIC_NAMES,
            (loc, lloc, sloc, comments, multi, blank, single, len(functions), sum(cc) / len(cc) if cc else 0.0, float(max(cc, default=0)), float(sum(cc)), *h,
             maintainability(h[2], sum(cc) or complexity(tree), sloc, comments / max(loc, 1)), sum(cog), max(cog, default=0)),
        ))
    return Analysis(measured, {"smell_count": sum(counts.values())} | counts, sorted(functions, key=lambda f: f["line"]))


def metrics(source: str | None) -> dict | None:
    """All file metrics, or None for a rejected text."""
    return None if source is None or len(source) > MAX_CHARACTERS else analysed(source).metrics


def functions_of(source: str | None) -> list[dict]:
    """(name, line, loc, params, nesting, cc) of every function, methods included."""
    return analysed(source).functions


def smells(source: str | None) -> dict[str, int]:
    """Seven smell counts and their sum; zeros for a text that does not parse."""
    return analysed(source).smells


def _guarded(f, bad):
    def one(source):
        try:
            return f(source)
        except (RecursionError, MemoryError, ValueError):
            return bad
    return one


def _typed(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({n: "Int32" for n in INT_METRICS if n in columns})


def with_metrics(files: DataFrame, source: str = "content") -> DataFrame:
    """Files with a ``metrics`` struct; texts over the size limit never reach Python."""

    @F.pandas_udf(METRICS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield _typed([_guarded(metrics, None)(x) or dict.fromkeys(METRIC_NAMES) for x in s], METRIC_NAMES)

    small = F.when(F.length(source) <= MAX_CHARACTERS, F.col(source))
    return files.withColumn("metrics", run.asNondeterministic()(small))  # else a filter on metrics would run it twice


def with_smells(files: DataFrame, source: str = "content") -> DataFrame:
    names = ["smell_count", *SMELLS]

    @F.pandas_udf(", ".join(f"{n} int" for n in names))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([_guarded(smells, _no_smells())(x) for x in s], columns=names).astype("int32")

    return files.withColumn("smells", run.asNondeterministic()(F.col(source)))


def _table(files: DataFrame, key: str, source: str, columns: str, rows) -> DataFrame:
    """(key, columns): the rows that ``rows`` makes of a file's source, which is read and parsed once."""
    names = [key, *[x.split()[0] for x in columns.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _typed([(k, *r) for k, s in zip(pdf[key], pdf[source]) for r in _guarded(rows, [])(s)], names)

    return spread(files.select(key, source)).mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, {columns}")


def metrics_table(files: DataFrame, key: str, source: str = "content") -> DataFrame:
    """One row of metrics per file that is not rejected."""
    small = files.where(F.length(source) <= MAX_CHARACTERS)
    return _table(small, key, source, METRICS, lambda s: [tuple(m.values())] if (m := metrics(s)) else [])


def smells_table(files: DataFrame, key: str, source: str = "content") -> DataFrame:
    """One row of smell counts per file; zeros where it does not parse."""
    safe = _guarded(smells, _no_smells())
    return _table(files, key, source, ", ".join(f"{n} int" for n in ("smell_count", *SMELLS)), lambda s: [tuple(safe(s).values())])


def function_table(files: DataFrame, key: str, source: str = "content") -> DataFrame:
    """One row per function: (key, name, line, loc, params, nesting, cc)."""
    return _table(files, key, source, "name string, line int, loc int, params int, nesting int, cc int", lambda s: [tuple(f.values()) for f in functions_of(s)])
