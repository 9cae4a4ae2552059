"""From text to tokens to facts: depth, layout, length."""

import time

import pytest

from sentrylane.functions.java_text import Unreadable, shape, shapes
from sentrylane.operators import facts as of
from sentrylane.operators.facts import extract_facts


def facts(spark, text):
    rows = extract_facts(spark.createDataFrame([("A.java", text)], "path string, content string")).orderBy("kind", "ordinal").collect()
    kinds = {"var": [], "call": [], "method": []}
    for r in rows:
        kinds[r.kind].append(r)
    return kinds


def body(spark, text):
    return facts(spark, "class A {\n  void m() {\n" + text + "\n  }\n}\n")


def variables(found):
    return [(r.line, r.type, r.name, r.init) for r in found["var"]]


def test_letters():
    plain, lines = shape('a.<B<C, D>>f(x  /* y */ , "s")\n  [0];')
    assert plain == 'a.<B<C, D>>f(x, "s") [0];'
    words = "".join(c for c in lines if not c.isdigit() and c != "_")
    assert words == "\n(w,s!\n[q#\n^w.<------>v()IJ;#"
    # Two arguments, the first at bytes 13 to 14; the bracket and the line of the index.
    assert "(12_13_12_1_2_13_14)" in lines and "I21_22_33_2J" in lines


@pytest.mark.parametrize("depth", [1, 16, 500])
def test_any_depth(spark, depth):
    java = body(spark, f"String query = {'(' * depth}\"SELECT a\" + x{')' * depth};\nrt.exec({'f(' * depth}\"a\" + x{')' * depth} + y);\n{'{' * depth}int z = 1;{'}' * depth}")
    assert [v[2] for v in variables(java)] == ["query", "z"]
    assert [c.name for c in java["call"]].count("f") == depth
    assert [m.name for m in java["method"]] == ["m"]


@pytest.mark.parametrize("depth", [1, 5, 60])
def test_any_type_arguments(spark, depth):
    kind = "List<" * depth + "String" + ">" * depth
    assert variables(body(spark, f"{kind} sql = f(x);")) == [(3, kind, "sql", "f(x)")]


@pytest.mark.parametrize("blanks", [0, 1, 16, 300])
def test_any_indentation(spark, blanks):
    java = facts(spark, "class A {\n  A()\n" + " " * blanks + "{ }\n  java.util.\n" + " " * blanks + "Random r = new Random();\n  void f() throws\n" + " " * blanks + "E { }\n}")
    assert variables(java) == [(5, "java.util.Random", "r", "new Random()")]
    assert java["call"] == [] and [m.name for m in java["method"]] == ["f"]


def test_escaped_quotes_in_a_text_block(spark):
    java = facts(spark, 'class A { String a = """\n x \\""" y \\\\\n"""; }\nclass B { String password = "abcd"; }')
    assert [(v[0], v[2]) for v in variables(java)] == [(1, "a"), (4, "password")]


def test_lambdas_comparisons_and_generic_calls(spark):
    java = body(spark, "a.map(x -> f(x)); if (b > g(1)) { } List<String> h(); c.<T>i(j); int k = a < b ? c(d) : e;")
    assert [(c.scope, c.name) for c in java["call"]] == [("a", "map"), (None, "f"), (None, "g"), ("c", "i"), (None, "c")]
    assert [v[2] for v in variables(java)] == ["k"]


def test_comparisons_are_no_type_arguments(spark):
    java = body(spark, "if (a < 1 && b > f(x)) { } g(c < d && e > ((H) y).z(), 2); Map<K, V> m = Map.<K, V>of(k, v);")
    assert [(c.scope, c.name, c.n_args) for c in java["call"]] == [(None, "f", 1), (None, "g", 2), ("((H) y)", "z", 0), ("Map", "of", 2)]
    assert variables(java) == [(3, "Map<K, V>", "m", "Map.<K, V>of(k, v)")]


def test_scope_behind_an_anonymous_class(spark):
    (call, *_) = [c for c in body(spark, "new A(1) { int b; }.run(x);")["call"] if c.name == "run"]
    assert call.scope == "new A(1) { int b; }"


def test_a_statement_behind_a_block_begins_anew(spark):
    java = body(spark, "if (a) { b(); } ((B) c).d(); while (e) (f).g();")
    assert [(c.scope, c.name) for c in java["call"]] == [(None, "b"), ("((B) c)", "d"), ("(e) (f)", "g")]


def test_facts_are_numbered_in_the_order_of_the_text(spark):
    java = body(spark, "int a = f(new X() { int b = 1; }), c = 2; int d = g(h());")
    assert [(v.name, v.ordinal) for v in java["var"]] == [("a", 0), ("c", 1), ("b", 2), ("d", 3)]
    assert [(c.name, c.ordinal) for c in java["call"]] == [("f", 0), ("g", 1), ("h", 2)]


def test_offsets_count_bytes(spark):
    java = body(spark, 'String größe = "日本" + é.ü("ß");')
    assert variables(java) == [(3, "String", "größe", '"日本" + é.ü("ß")')]
    assert [(c.scope, c.name, c.arg0) for c in java["call"]] == [("é", "ü", '"ß"')]
    (method,) = java["method"]
    assert method.text.endswith('"日本" + é.ü("ß");\n  }')


@pytest.mark.parametrize("text", ['"open', "'", "/* open", "(", ")", "{", "(]", '"""\nx'])
def test_unreadable(text):
    with pytest.raises(Unreadable):
        shape(f"class A {{ {text} }}")


PIECES = ["int a = b ", "a < b < ", "List<List<", "x.y(z)", ".y(z)", "f(a, ", "((", "a[b", "@A ", "a = b = ", "int a = b, c = d, ", "final ", "a.b"]


def of_one_statement(piece, n):
    text = "class A { void m() { " + piece * n
    close = []
    for c in text:
        if c in "([{":
            close.append({"(": ")", "[": "]", "{": "}"}[c])
        elif c in ")]}":
            close.pop()
    return text + "".join(reversed(close))


@pytest.mark.parametrize("piece", PIECES, ids=str)
def test_linear(piece):
    """Text of one statement, eight times as long, takes no more than some sixteen times as long."""

    def took(n):
        text, best = of_one_statement(piece, n), 9e9
        for _ in range(3):
            start = time.perf_counter()
            shape(text)
            best = min(best, time.perf_counter() - start)
        return best

    small, large = took(2000), took(16000)
    assert large < 16 * small + 0.05


def test_patterns_neither_recurse_nor_backtrack(spark):
    files = spark.createDataFrame([(p, of_one_statement(p, 16000)) for p in PIECES if p != ".y(z)"], "path string, content string")
    start = time.perf_counter()
    counts = {(r.path, r.kind): r["count"] for r in extract_facts(files).groupBy("path", "kind").count().collect()}
    assert time.perf_counter() - start < 30
    assert counts["f(a, ", "call"] == counts["x.y(z)", "call"] == 16000
    assert all(counts[p, "method"] == 1 for p in PIECES if p != ".y(z)")


def nested(depth, types):
    return (
        f"class N {{\n  void m(String x) {{\n    String query = {'(' * depth}\"SELECT a\" + x{')' * depth};\n    rt.exec({'a[' * depth}0{']' * depth} + y);\n"
        f"    {'List<' * types}String{'>' * types} sql = x;\n    {'{ ' * depth}int deep = 1;{' }' * depth}\n  }}\n}}\n"
    )


def test_nested_texts_are_read_in_time():
    """4,000 texts of some 300 tokens; token by token in Python they take more than two seconds."""
    texts, best = [nested(1 + k % 60, 1 + k % 10).encode() for k in range(4000)], 9e9
    for _ in range(3):
        start = time.perf_counter()
        assert sum(plain is not None for plain, _ in shapes(texts)) == 4000
        best = min(best, time.perf_counter() - start)
    assert best < 1.2


def test_only_lines_that_can_hold_a_fact_are_written(spark):
    """Brackets without = and without a call add nothing to the letters; the facts stay whole."""
    files = spark.createDataFrame([(str(d), nested(d, 2)) for d in (1, 500)], "path string, content string")
    lines = [r["_letters"].count("\n") for r in of._lettered(files, ["path"]).collect()]
    assert lines[0] == lines[1] < 6
    found = [[(v.name, v.type) for v in facts(spark, nested(d, 2))["var"]] for d in (1, 500)]
    assert found[0] == found[1] == [("query", "String"), ("sql", "List<List<String>>"), ("deep", "int")]
    full = shape(nested(3, 2))[1].split("\n")
    ((_, some),) = shapes([nested(3, 2).encode()])
    assert some.decode().split("\n")[1:] == [x for x in full if "=" in x or "v" in x or x.startswith("{w") and "(" in x]


@pytest.mark.parametrize("bytes_", [1, 40, 1 << 18])
def test_texts_read_together_are_as_read_alone(bytes_, monkeypatch):
    """Whatever stands beside a text: one without end, a number, a dot, letters of several bytes, nothing."""
    from sentrylane.functions import java_text

    texts = ["", " ", "a", "1.", ".5", "1.5.6 x1.5 1$a$ .", "..", ".", "a....b", "-", "->=:::==", "=", "größe.ü(١٢, \u3000日本)", "a.<B>", "c(d, e)",
             "List<A, B[]> m = A.<B, C>of(1, 2);", "a < b", "> c", "(", ")", "(]", "{ /* open", "*/ }", '"open', "'", '"', '"""x', '"""\n " y"""', "// z", "\n@A f() { }"]

    def alone(text):
        try:
            return tuple(x.encode() for x in shape(text))
        except Unreadable:
            return None, None

    expected = [(None, None), *map(alone, texts), *map(alone, reversed(texts))]
    assert sum(plain is None for plain, _ in expected) > 15
    monkeypatch.setattr(java_text, "_BYTES", bytes_)
    together = [None, *(t.encode() for t in [*texts, *reversed(texts)])]
    assert list(shapes(together, every_line=True)) == expected
