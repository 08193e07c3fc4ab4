from __future__ import annotations

import pytest

from forgelens.operators import source_ast as s


def body(n, indent="    "):
    return "".join(f"{indent}x{i} = {i} + {i}\n" for i in range(n))


@pytest.mark.parametrize(("source", "smell"), [
    ("def f():\n" + body(60), "smell_long_method"),
    ("class C:\n" + "".join(f"    def m{i}(self):\n" + body(45, "        ") for i in range(12)), "smell_large_class"),
    ("def f(a, b, c, d, e, g, h):\n    pass\n", "smell_long_param_list"),
    ("def f(a):\n" + "".join("    " * (i + 1) + f"if a > {i}:\n" for i in range(5)) + "    " * 6 + "pass\n", "smell_deep_nesting"),
    ("def f(a):\n" + "".join(f"    if a == {i}:\n        a += 1\n" for i in range(15)), "smell_high_complexity"),
    ("def f(a):\n" + "".join(f"    if a == {i}:\n        a += 1\n" for i in range(17)) + body(90), "smell_god_function"),
    ("".join(f"def f{k}(a, b):\n" + "".join(f"    if a > {i} and b < {i} or a == b:\n        a = a * {i} - b / {i + 1} % 7\n" for i in range(20)) for k in range(60)), "smell_low_maintainability"),
])
def test_each_smell(source, smell):
    found = s.smells(source)
    assert found[smell] >= 1 and found["smell_count"] == sum(found[k] for k in s.SMELLS)


def test_clean_malformed_and_missing():
    clean = 'def add(a, b):\n    """Add."""\n    return a + b\n'
    assert not any(s.smells(clean).values())
    assert not any(s.smells("def f(\n").values()) and not any(s.smells(None).values())
    assert s.metrics("def f(\n") is None and s.metrics("x = 1\n") is None and s.metrics("x" * 500_001) is None


def test_metrics_and_functions():
    src = "def f(a):\n    # why\n    if a:\n        return 1\n    return 2\n" + body(12, "")
    m = s.metrics(src)
    assert m["num_functions"] == 1 and m["cc_total"] == 2 and m["comments"] == 1 and m["cc_max"] <= m["cc_total"] and 0 <= m["maintainability_index"] <= 100
    assert [f["name"] for f in s.functions_of("def a(): pass\nclass C:\n    async def b(self, *x, k=1, **y): pass\n")] == ["a", "b"]
    assert s.functions_of("class C:\n    async def b(self, p, *x, k=1, **y): pass\n")[0]["params"] == 5


def test_columns(spark):
    df = spark.createDataFrame([(1, "def f():\n" + body(60)), (2, "def f(\n"), (3, None)], "id int, content string")
    got = {r.id: r for r in s.with_smells(s.with_metrics(df)).collect()}
    assert got[1].metrics.loc == 61 and got[1].smells.smell_long_method == 1
    assert got[2].metrics.loc is None and got[3].smells.smell_count == 0
    assert s.function_table(df, "id").count() == 1


def test_operands_are_told_apart_to_their_end():
    import ast

    same = "x = compute(a, b, gamma_value_one_of_a_very_long_name_indeed) + compute(a, b, gamma_value_one_of_a_very_long_name_indeed)"
    other = same[:-5] + "deee)"
    assert s.halstead(list(ast.walk(ast.parse(same))))[0] == 2 and s.halstead(list(ast.walk(ast.parse(other))))[0] == 3
    assert s.halstead(list(ast.walk(ast.parse("x += 1\ny = x * x"))))[0] == 4  # two operators, x and 1


def test_long_chains_cost_their_nodes(spark):
    import time

    source = "x = " + " + ".join(f"a{i}" for i in range(3000)) + "\n" + "y = 1\n" * 12
    began = time.time()
    assert s.metrics(source)["h_length"] == 2 * 2999 + 2999 and time.time() - began < 5
    plan = s.metrics_table(spark.createDataFrame([(1, source)], "id int, content string"), "id").where("loc > 3")
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1 and plan.count() == 1
