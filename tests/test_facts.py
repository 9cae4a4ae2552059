"""Fact extraction against hand-written Java."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrylane.functions.java_text import shape
from sentrylane.operators import facts as of
from sentrylane.operators.facts import extract_facts
from sentrylane.operators.static_rules import STATIC_RULES, method_words, static_findings


def facts(spark, text, **kw):
    files = spark.createDataFrame([("A.java", text)], "path string, content string")
    rows = extract_facts(files, **kw).collect()
    return sorted(rows, key=lambda r: (r.line, r.kind, r.name))


def shown(rows, kind):
    if kind == "var":
        return [(r.line, r.type, r.name, r.init) for r in rows if r.kind == "var"]
    if kind == "call":
        return [(r.line, r.scope, r.name, r.arg0, r.n_args) for r in rows if r.kind == "call"]
    return [(r.line, r.name) for r in rows if r.kind == "method"]


def in_method(body):
    return "class A {\n  void m() {\n" + body + "\n  }\n}\n"


VARS = [
    ('int a = 1;', [(3, "int", "a", "1")]),
    ('String a = "x", b, c = d;', [(3, "String", "a", '"x"'), (3, "String", "c", "d")]),
    ('final Map<String, List<int[]>> a =\n  new HashMap<>();', [(3, "Map<String, List<int[]>>", "a", "new HashMap<>()")]),
    ('byte[] a = {1, 2}, b[] = null;', [(3, "byte[]", "a", "{1, 2}"), (3, "byte[]", "b", "null")]),
    ('a = 1; b == c; return d;', []),
    ('String a;', []),
    ('String a = "q\\"; int z = 1; // no";', [(3, "String", "a", '"q\\"; int z = 1; // no"')]),
    ("char a = '\"'; char b = '\\'';", [(3, "char", "a", "'\"'"), (3, "char", "b", "'\\''")]),
    ('/* int z = 1;\n int y = 2; */ int a = 3; // int x = 4;', [(4, "int", "a", "3")]),
    ('int a /* why\n not */ = 3;', [(3, "int", "a", "3")]),
    ('String a = """\n  int z = 1; "quoted"\n  """; int b = 2;',
     [(3, "String", "a", '"""\n  int z = 1; "quoted"\n  """'), (5, "int", "b", "2")]),
    ('boolean a = x < y && z > w;', [(3, "boolean", "a", "x < y && z > w")]),
    ('try (Reader a = open(b); Reader c = d) { }', [(3, "Reader", "a", "open(b)"), (3, "Reader", "c", "d")]),
    ('for (int i = 0, n = k; i < n; i++) { }', [(3, "int", "i", "0"), (3, "int", "n", "k")]),
    ('for (byte b : bytes) { }', []),
    ('java . util . Random a = new java.util.Random( );', [(3, "java.util.Random", "a", "new java.util.Random()")]),
    ('if (o instanceof Foo f) { int größe = 1; }', [(3, "int", "größe", "1")]),
]

CALLS = [
    ('a.b(c);', [(3, "a", "b", "c", 1)]),
    ('b();', [(3, None, "b", None, 0)]),
    ('return b(1, 2);', [(3, None, "b", "1", 2)]),
    ('new B(c(d));', [(3, None, "c", "d", 1)]),
    ('new a.B(1).c(2);', [(3, "new a.B(1)", "c", "2", 1)]),
    ('new a.B(1);', []),
    ('if (a) while (b) for (;;) switch (c) { }', []),
    ('a\n  .b()\n  .c("x" + d);', [(3, "a", "b", None, 0), (3, "a.b()", "c", '"x" + d', 1)]),
    ('((B) a).c("(", d);', [(3, "((B) a)", "c", '"("', 2)]),
    ('return ((B) a).c();', [(3, "((B) a)", "c", None, 0)]),
    ('a[0].b(c[1], d(2));', [(3, "a[0]", "b", "c[1]", 2), (3, None, "d", "2", 1)]),
    ('a.<String>b(new HashMap<String, Integer>(), c);', [(3, "a", "b", "new HashMap<String, Integer>()", 2)]),
    ('a.b(x -> { return c(x); }, d);', [(3, "a", "b", "x -> { return c(x); }", 2), (3, None, "c", "x", 1)]),
    ('"s".length();', [(3, '"s"', "length", None, 0)]),
    ('a.b("c, d(e)", f);', [(3, "a", "b", '"c, d(e)"', 2)]),
    ('@Foo(bar) int x;', []),
    ('this.a(); super.b();', [(3, "this", "a", None, 0), (3, "super", "b", None, 0)]),
    ('super(a);', []),
    ('// a.b();\n/* c.d(); */ e.f();', [(4, "e", "f", None, 0)]),
]


@pytest.fixture(scope="module")
def by_body(spark):
    """Facts of every body above, extracted in one job."""
    bodies = [body for body, _ in VARS + CALLS]
    files = spark.createDataFrame([(b, in_method(b)) for b in bodies], "path string, content string")
    found = {b: [] for b in bodies}
    for r in extract_facts(files).collect():
        found[r.path].append(r)
    return found


@pytest.mark.parametrize("body, want", VARS)
def test_declarations(by_body, body, want):
    assert sorted(shown(by_body[body], "var")) == sorted(want)


@pytest.mark.parametrize("body, want", CALLS)
def test_calls(by_body, body, want):
    assert sorted(shown(by_body[body], "call"), key=str) == sorted(want, key=str)


def test_methods_and_constructors(spark):
    text = (
        "class A {\n"
        "  A(int x) { }\n"
        "  public A() throws E { }\n"
        "  // note\n"
        "  @Override\n"
        "  public static <T> List<T> a(int b) throws E, F { return null; }\n"
        "  Object o = new Object() {\n"
        "    int b() { if (c) { return 1; } else { return 2; } } };\n"
        "  abstract void d();\n"
        "}\n"
    )
    assert shown(facts(spark, text), "method") == [(5, "a"), (8, "b")]


def test_method_text_keeps_comments_and_hint_skips_files(spark):
    text = "class A {\n void m() { // HostnameVerifier\n return true; } }\n"
    (row,) = [r for r in facts(spark, text) if r.kind == "method"]
    assert row.text == "void m() { // HostnameVerifier\n return true; }"
    assert shown(facts(spark, text, method_words=("HostnameVerifier",)), "method") == [(2, "m")]
    assert shown(facts(spark, text, method_words=("X509TrustManager",)), "method") == []


@pytest.mark.parametrize(
    "text",
    ['class A { String a = "open; }', "class A { int a = 1;", "class A { int a = f(1; }", "class A { /* int a = 1; }", None],
)
def test_text_that_does_not_tokenise_gives_nothing(spark, text):
    assert facts(spark, text) == []


def test_very_long_literals_comments_and_statements(spark):
    """Nothing recurses with the length of the text, and lines stay right."""
    note = "* ' \" ( {\n" * 30_000
    text = (
        "class A {\n/*" + note + "*/\n"
        'String token = "' + "(x\\\"" * 100_000 + '";\n'
        "int[] a = {" + "1, " * 50_000 + "2};\n"
        "Object b = c" + ".d(1)" * 300 + ";\n}\n"
    )
    rows = facts(spark, text)
    first = 2 + 30_000 + 1
    assert [(r.line, r.name) for r in rows if r.kind == "var"] == [(first, "token"), (first + 1, "a"), (first + 2, "b")]
    assert len([r for r in rows if r.kind == "call"]) == 300
    token = [r for r in rows if r.name == "token"][0]
    assert token.init == '"' + "(x\\\"" * 100_000 + '"'


def test_windows_line_ends_and_internal_characters(spark):
    text = "class A {\r\n  int a\ufdd0 = 1;\r\n  int b = 2;\r\n}\r\n"
    assert shown(facts(spark, text), "var") == [(2, "int", "a", "1"), (3, "int", "b", "2")]


SAMPLE = '''package demo;

/** String password = "in a comment"; */
public class Sample {
    private static final String DB_PASSWORD = "hunter22";   // S03
    static final String EMPTY_TOKEN = "";
    Random random = new Random();                           // S21

    void a(String id) throws Exception {
        String sql = "DELETE FROM t WHERE id='" + id
            + "'";                                          // S01, line 10
        statement.executeUpdate("UPDATE t SET a=" + id);    // S02
        statement.executeQuery(sql);
        Runtime.getRuntime().exec("ls " + id);              // S07
        Runtime.getRuntime().exec(new String[]{"ls", id});
        ProcessBuilder p = new ProcessBuilder("sh", "-c", "x" + id); // S09
        MessageDigest.getInstance("md5");                   // S16
        Cipher c = Cipher.getInstance("DES/ECB/NoPadding"); // S19
        URL u = new URL("http://example.com");              // S24
        URL v = new URL("http://localhost/x");
        SSLContext s = SSLContext.getInstance("SSLv3");     // S25
        File.createTempFile("a", "b");                      // S28
    }

    void trust() {
        TrustManager[] all = { new X509TrustManager() {
            public void checkServerTrusted(X509Certificate[] c, String t) {
            }
        } };
    }

    void verify() {
        use(new HostnameVerifier() {
            public boolean verify(String h, SSLSession s) { return true; }
        });
    }
}
'''


def test_rules_over_source_text(spark):
    files = spark.createDataFrame([("Sample.java", SAMPLE)], "path string, content string")
    found = static_findings(extract_facts(files, method_words=method_words(STATIC_RULES))).collect()
    assert sorted((r.line, r.rule_id, r.match_key) for r in found) == [
        (5, "S03", "password"), (7, "S21", ""), (10, "S01", ""), (12, "S02", ""), (14, "S07", ""),
        (16, "S09", ""), (17, "S16", ""), (18, "S19", ""), (19, "S24", ""), (21, "S25", ""),
        (22, "S28", ""), (25, "S22", ""), (32, "S23", ""),
    ]
    by_rule = {r.rule_id: r for r in found}
    assert by_rule["S03"].description == 'Hardcoded credential found: db_password = "hunter22"'
    assert by_rule["S01"].location == "Sample.java:10" and by_rule["S01"].cwe_id == "CWE-89"
    assert len({r.finding_id for r in found}) == len(found)


def test_extraction_is_one_map_stage(spark):
    files = spark.createDataFrame([("A.java", SAMPLE)], "path string, content string")
    plan = static_findings(extract_facts(files))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("MapInArrow") == 1 and "Sort" not in plan


def test_batches_of_long_texts_are_bounded(spark):
    """An Arrow batch of 10,000 rows is no bound where texts are long: bytes of a batch are, in and out."""
    text = "class A { /* " + "x" * 100_000 + ' */ String a = """\n' + "y" * 100_000 + '\n"""; }'
    files = spark.range(0, 300, 1, 1).selectExpr("CAST(id AS STRING) AS path").withColumn("content", F.lit(text))
    rows = of._lettered(files, ["path"])
    assert int(spark.conf.get(of._LIMIT)) <= of._BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    # In: what a mapInArrow gets now; out: all rows come back, whole.
    assert max(r.n for r in files.mapInArrow(sizes, "n long").collect()) <= of._BYTES // 200_000 + 1
    assert rows.agg(F.count("*"), F.sum(F.length("_plain"))).first() == (300, 300 * len(shape(text)[0]))
    assert extract_facts(files).filter("name = 'a'").count() == 300
