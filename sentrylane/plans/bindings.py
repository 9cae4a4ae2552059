"""Engine tables derived from the provided star-schema and text tables.

The provided tables hold no Java code, security events or CVEs, so each engine table is
a projection of one of them, row for row: templates are picked by a key and filled from
columns. A projection is written once, as SQL expressions that mean the same to Spark
and to the checking database. All inputs are therefore synthetic derivations that grow
with the tables they read.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentrylane.sources.dimensions import literal_table


@dataclass(frozen=True)
class Derivation:
    """``table`` projected to ``columns``. ``templates`` are rows picked by ``index``, an
    expression that gives their first column, the template number ``t``."""

    table: str
    columns: dict[str, str]
    index: str | None = None
    templates: tuple[tuple, ...] = ()
    names: tuple[str, ...] = ()
    #: Deal the source rows (keys, no texts) to all cores first, and to more tasks where one
    #: would get more rows than this: a provided table is one file, which one task reads,
    #: where a repository is listed file by file.
    dealt: int | None = None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{self.table}.parquet")
        return self.of(dealt(rows, self.dealt) if self.dealt else rows)

    def of(self, rows: DataFrame) -> DataFrame:
        """The same projection of a given (possibly streaming) DataFrame."""
        if self.index:
            schema = ", ".join(["t bigint", *[f"{n} {_type(v)}" for n, v in zip(self.names, zip(*self.templates))]])
            numbered = tuple((i, *t) for i, t in enumerate(self.templates))
            table = literal_table(rows.sparkSession, numbered, T.StructType.fromDDL(schema))
            rows = rows.withColumn("t", F.expr(self.index)).join(table, "t")
        return rows.selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        source = self.table
        if self.index:
            rows = ", ".join(
                "(" + ", ".join(_text(v) for v in (i, *t)) + ")" for i, t in enumerate(self.templates)
            )
            source = (
                f"(SELECT *, {self.index} AS t FROM {self.table}) AS numbered JOIN "
                f"(VALUES {rows}) AS template(t, {', '.join(self.names)}) USING (t)"
            )
        return f"SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {source}"


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """Rows of a table in tasks of at most about ``most`` rows, one per core at least.

    The count reads the footers of the table's files.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)))


def _type(values) -> str:
    return "int" if any(isinstance(v, int) for v in values) else "string"


def _text(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def filled(column: str, **keys: str) -> str:
    """SQL text of a template column with ``{x}`` replaced by the value of column ``x``."""
    for name, key in keys.items():
        column = f"replace({column}, '{{{name}}}', CAST({key} AS STRING))"
    return column


def pick(index: str, options: list[str]) -> str:
    """CASE over a template number."""
    branches = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {index} {branches} END"


# --- code facts, from lineitem ------------------------------------------------------

#: Fact templates, a hit and a near miss for every static rule.
#: var: (type, name, init); call: (scope, name, first argument, arguments); method: (name, text).
VARS = (
    ("String", "userQuery", '"SELECT * FROM t{p} WHERE id=" + id'),
    ("String", "sqlText", '"select a" + b{p}'),
    ("String", "query", '"SELECT {p}"'),
    ("String", "call", '"CALL f(" + x{p}'),
    ("String", "DB_PASSWORD", '"pw{p}"'),
    ("String", "API_KEY", '"sk-{p}-{o}-abcdefghijklmnopqrstuvwxyz"'),
    ("String", "authToken", '"t{p}" + f()'),
    ("String", "secret", '"a"'),
    ("ObjectInputStream", "ois", "new ObjectInputStream(bis{p})"),
    ("Object", "o", "wrap(new ObjectInputStream(x{p}))"),
    ("XMLDecoder", "d", "new java.beans.XMLDecoder(in{p})"),
    ("ProcessBuilder", "pb", 'new ProcessBuilder("sh", "-c", "./r{p}" + n)'),
    ("ProcessBuilder", "pb", 'new ProcessBuilder("ls{p}")'),
    ("String", "page", '"<html>" + body{p}'),
    ("String", "link", '"<a href=x{p}>" + t'),
    ("String", "page", '"<div>{p}"'),
    ("DocumentBuilderFactory", "f", "DocumentBuilderFactory.newInstance()"),
    ("Object", "f", "SAXParserFactory.newInstance()"),
    ("XMLReader", "r", "make({p})"),
    ("Random", "r", "new Random()"),
    ("SecureRandom", "r", "new SecureRandom()"),
    ("URL", "u", 'new URL("http://api{p}.example.com")'),
    ("URL", "u", 'new URL("http://localhost:{p}")'),
    ("SSLContext", "c", 'SSLContext.getInstance("TLSv1")'),
    ("SSLContext", "c", 'SSLContext.getInstance("TLSv1.2")'),
    ("Socket", "s", "new Socket(host, {p})"),
    ("SSLSocket", "s", "new Socket(host, {p})"),
    ("int", "count", "{p}"),
)
CALLS = (
    ("stmt", "executeQuery", '"SELECT " + c{p}', 1),
    ("stmt", "execute", "sql{p}", 1),
    ("stmt", "executeUpdate", "a.concat(b{p})", 1),
    ("((ObjectInputStream) in{p})", "readObject", None, 0),
    ("ois{p}", "readObject", None, 0),
    ("Runtime.getRuntime()", "exec", '"ping " + h{p}', 1),
    ("rt", "exec", "cmd{p}", 2),
    ("engine", "eval", "code{p}", 1),
    ("out", "println", '"<h1>" + n{p}', 1),
    ("out", "println", '"total: " + n{p}', 1),
    ("doc", "innerHTML", "x{p}", 1),
    ("MessageDigest", "getInstance", '"MD5"', 1),
    ("MessageDigest", "getInstance", '"sha-1"', 1),
    ("Cipher", "getInstance", '"DES"', 1),
    ("Cipher", "getInstance", '"AES/ECB/PKCS5Padding"', 1),
    ("MessageDigest", "getInstance", '"SHA-256"', 1),
    ("Random", "nextInt", None, 0),
    ("random", "nextInt", None, 0),
    ("f", "newDocumentBuilder", None, 0),
    ("File", "createTempFile", "p{p}", 2),
    ("Files", "readString", "p{p}", 1),
)
METHODS = (
    (
        "trust",
        "void trust{p}() { new X509TrustManager() { public void checkClientTrusted() { } }; }",
    ),
    ("verify", "void v{p}() { new HostnameVerifier() { boolean verify() { return true; } }; }"),
    ("plain", "int f() { return {p}; }"),
)

_FACT_ROWS = (
    *[("var", t, n, i, None, None, None, None) for t, n, i in VARS],
    *[("call", None, n, None, s, a, k, None) for s, n, a, k in CALLS],
    *[("method", None, n, None, None, None, None, x) for n, x in METHODS],
)
_PART = dict(p="l_partkey", o="l_orderkey")

FACTS = Derivation(
    "lineitem",
    {
        "repo": "'repo-' || CAST(l_suppkey AS STRING)",
        "path": "'src/m' || CAST(l_suppkey AS STRING) || '/F' || CAST(l_orderkey AS STRING) || '.java'",
        "ordinal": "CAST(l_partkey AS INT)",
        "kind": "kind",
        "line": "CAST(l_linenumber AS INT)",
        "type": "type_text",
        "name": "name_text",
        "init": filled("init_text", **_PART),
        "scope": filled("scope_text", **_PART),
        "arg0": filled("arg_text", **_PART),
        "n_args": "args",
        "text": filled("body_text", **_PART),
    },
    f"(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {len(_FACT_ROWS)}",
    _FACT_ROWS,
    ("kind", "type_text", "name_text", "init_text", "scope_text", "arg_text", "args", "body_text"),
    dealt=1_000_000,
)


# --- Java source text, from orders and documents ------------------------------------

#: What surrounds each body: five lines before it, two after.
_FILE_HEAD = (
    "package com.example.orders;\n"
    '/* Order {o}: String password = "not code"; exec("a" + b);\n'
    " * second line // not code either */\n"
    'public class Order{o} { // String secret = "commented out";\n'
    "    void run(String arg) throws Exception {\n"
)
_FILE_TAIL = "\n    }\n}\n"

#: Bodies with the facts they hold: (line, kind, type, name, init, scope, arg0, n_args),
#: and the findings: (line, rule, match key). The first body line is line 6.
SOURCES = (
    (
        '        String query = "SELECT a FROM t{o} WHERE b=" +\n            arg;',
        ((6, "var", "String", "query", '"SELECT a FROM t{o} WHERE b=" + arg', None, None, None),),
        ((6, "S01", ""),),
    ),
    (
        '        Runtime.getRuntime()\n            .exec("ping {o} " + arg);',
        (
            (6, "call", None, "exec", None, "Runtime.getRuntime()", '"ping {o} " + arg', 1),
            (6, "call", None, "getRuntime", None, "Runtime", None, 0),
        ),
        ((6, "S07", ""),),
    ),
    (
        '        String apiKey = "k-{o}", other = arg;',
        (
            (6, "var", "String", "apiKey", '"k-{o}"', None, None, None),
            (6, "var", "String", "other", "arg", None, None, None),
        ),
        ((6, "S03", "apikey"), (6, "S03", "key")),
    ),
    (
        "        Map<String, List<Integer>> m = new HashMap<>();\n"
        '        m.put("a;b(c" + {o}, f(1, 2));',
        (
            (6, "var", "Map<String, List<Integer>>", "m", "new HashMap<>()", None, None, None),
            (7, "call", None, "put", None, "m", '"a;b(c" + {o}', 2),
            (7, "call", None, "f", None, None, "1", 2),
        ),
        (),
    ),
    (
        "        java.security.MessageDigest md =\n"
        '            java.security.MessageDigest.getInstance("MD5");',
        (
            (
                6, "var", "java.security.MessageDigest", "md",
                'java.security.MessageDigest.getInstance("MD5")', None, None, None,
            ),
            (7, "call", None, "getInstance", None, "java.security.MessageDigest", '"MD5"', 1),
        ),
        ((7, "S16", ""),),
    ),
    (
        "        Callable<Object> c = () -> {\n"
        '            String token = "t-{o}";\n'
        "            return eval(token);\n"
        "        };",
        (
            (
                6, "var", "Callable<Object>", "c",
                '() -> { String token = "t-{o}"; return eval(token); }', None, None, None,
            ),
            (7, "var", "String", "token", '"t-{o}"', None, None, None),
            (8, "call", None, "eval", None, None, "token", 1),
        ),
        ((7, "S03", "token"), (8, "S08", "")),
    ),
    (
        '        int q = (int) {o}; /* "x */ String note = "a /* b // c";',
        (
            (6, "var", "int", "q", "(int) {o}", None, None, None),
            (6, "var", "String", "note", '"a /* b // c"', None, None, None),
        ),
        (),
    ),
    (
        "        for (int i = 0, n = arg.length(); i < n; i++) {\n"
        '            out.println("<b>{o}" + i);\n'
        "        }",
        (
            (6, "var", "int", "i", "0", None, None, None),
            (6, "var", "int", "n", "arg.length()", None, None, None),
            (6, "call", None, "length", None, "arg", None, 0),
            (7, "call", None, "println", None, "out", '"<b>{o}" + i', 1),
        ),
        ((7, "S10", ""),),
    ),
    (
        "        HttpsURLConnection.setDefaultHostnameVerifier(\n"
        "            new HostnameVerifier() {\n"
        "                public boolean verify(String h, SSLSession s) { return true; }\n"
        "            });",
        (
            (
                6, "call", None, "setDefaultHostnameVerifier", None, "HttpsURLConnection",
                "new HostnameVerifier() { public boolean verify(String h, SSLSession s) "
                "{ return true; } }", 1,
            ),
            (8, "method", None, "verify", None, None, None, None),
        ),
        ((5, "S23", ""),),
    ),
    ("        return;", (), ()),
    (
        "        try (Socket s = new Socket(arg, {o})) {\n            s.close();\n        }",
        (
            (6, "var", "Socket", "s", "new Socket(arg, {o})", None, None, None),
            (7, "call", None, "close", None, "s", None, 0),
        ),
        ((6, "S26", ""),),
    ),
    (
        '        String html = arg == null ? "<div>" : "<div>{o}" + arg.trim();',
        (
            (
                6, "var", "String", "html",
                'arg == null ? "<div>" : "<div>{o}" + arg.trim()', None, None, None,
            ),
            (6, "call", None, "trim", None, "arg", None, 0),
        ),
        ((6, "S12", ""),),
    ),
    # A hit and a near miss of each rule that no body above has.
    (
        '        stmt.executeQuery("SELECT " + arg);\n        stmt.executeQuery(arg);',
        (
            (6, 'call', None, 'executeQuery', None, 'stmt', '"SELECT " + arg', 1),
            (7, 'call', None, 'executeQuery', None, 'stmt', 'arg', 1),
        ),
        ((6, 'S02', ""),),
    ),
    (
        '        ObjectInputStream ois = in{o};\n        ObjectOutputStream oos = in{o};',
        (
            (6, 'var', 'ObjectInputStream', 'ois', 'in{o}', None, None, None),
            (7, 'var', 'ObjectOutputStream', 'oos', 'in{o}', None, None, None),
        ),
        ((6, 'S04', ""),),
    ),
    (
        '        XMLDecoder d = x{o};\n        XMLEncoder e = x{o};',
        (
            (6, 'var', 'XMLDecoder', 'd', 'x{o}', None, None, None),
            (7, 'var', 'XMLEncoder', 'e', 'x{o}', None, None, None),
        ),
        ((6, 'S05', ""),),
    ),
    (
        '        ((ObjectInputStream) in).readObject();\n        in.readObject();',
        (
            (6, 'call', None, 'readObject', None, '((ObjectInputStream) in)', None, 0),
            (7, 'call', None, 'readObject', None, 'in', None, 0),
        ),
        ((6, 'S06', ""),),
    ),
    (
        '        ProcessBuilder pb = new ProcessBuilder("sh" + arg);\n        ProcessBuilder pc = new ProcessBuilder(arg);',
        (
            (6, 'var', 'ProcessBuilder', 'pb', 'new ProcessBuilder("sh" + arg)', None, None, None),
            (7, 'var', 'ProcessBuilder', 'pc', 'new ProcessBuilder(arg)', None, None, None),
        ),
        ((6, 'S09', ""),),
    ),
    (
        '        doc.innerHTML(x{o});\n        doc.innerXML(x{o});',
        (
            (6, 'call', None, 'innerHTML', None, 'doc', 'x{o}', 1),
            (7, 'call', None, 'innerXML', None, 'doc', 'x{o}', 1),
        ),
        ((6, 'S11', ""),),
    ),
    (
        '        DocumentBuilderFactory f = a{o};\n        DocumentBuilder g = a{o};',
        (
            (6, 'var', 'DocumentBuilderFactory', 'f', 'a{o}', None, None, None),
            (7, 'var', 'DocumentBuilder', 'g', 'a{o}', None, None, None),
        ),
        ((6, 'S13', ""),),
    ),
    (
        '        Object f = SAXParserFactory.newInstance();\n        SAXParser p = a{o};',
        (
            (6, 'var', 'Object', 'f', 'SAXParserFactory.newInstance()', None, None, None),
            (6, 'call', None, 'newInstance', None, 'SAXParserFactory', None, 0),
            (7, 'var', 'SAXParser', 'p', 'a{o}', None, None, None),
        ),
        ((6, 'S14', ""),),
    ),
    (
        '        XMLReader r = a{o};\n        XMLWriter w = a{o};',
        (
            (6, 'var', 'XMLReader', 'r', 'a{o}', None, None, None),
            (7, 'var', 'XMLWriter', 'w', 'a{o}', None, None, None),
        ),
        ((6, 'S15', ""),),
    ),
    (
        '        MessageDigest.getInstance("sha-1");\n        MessageDigest.getInstance("SHA-256");',
        (
            (6, 'call', None, 'getInstance', None, 'MessageDigest', '"sha-1"', 1),
            (7, 'call', None, 'getInstance', None, 'MessageDigest', '"SHA-256"', 1),
        ),
        ((6, 'S17', ""),),
    ),
    (
        '        Cipher.getInstance("DES");\n        Cipher.getInstance("DESede");',
        (
            (6, 'call', None, 'getInstance', None, 'Cipher', '"DES"', 1),
            (7, 'call', None, 'getInstance', None, 'Cipher', '"DESede"', 1),
        ),
        ((6, 'S18', ""),),
    ),
    (
        '        Cipher.getInstance("AES/ECB/NoPadding");\n        Cipher.getInstance("AES/GCM/NoPadding");',
        (
            (6, 'call', None, 'getInstance', None, 'Cipher', '"AES/ECB/NoPadding"', 1),
            (7, 'call', None, 'getInstance', None, 'Cipher', '"AES/GCM/NoPadding"', 1),
        ),
        ((6, 'S19', ""),),
    ),
    (
        '        Random.nextInt();\n        random.nextInt();',
        (
            (6, 'call', None, 'nextInt', None, 'Random', None, 0),
            (7, 'call', None, 'nextInt', None, 'random', None, 0),
        ),
        ((6, 'S20', ""),),
    ),
    (
        '        Random r = new Random();\n        SecureRandom s = new SecureRandom();',
        (
            (6, 'var', 'Random', 'r', 'new Random()', None, None, None),
            (7, 'var', 'SecureRandom', 's', 'new SecureRandom()', None, None, None),
        ),
        ((6, 'S21', ""),),
    ),
    (
        '        URL u = new URL("http://example.com/{o}");\n        URL v = new URL("http://localhost/{o}");',
        (
            (6, 'var', 'URL', 'u', 'new URL("http://example.com/{o}")', None, None, None),
            (7, 'var', 'URL', 'v', 'new URL("http://localhost/{o}")', None, None, None),
        ),
        ((6, 'S24', ""),),
    ),
    (
        '        SSLContext.getInstance("TLSv1");\n        SSLContext c = SSLContext.getInstance("SSLv3");',
        (
            (6, 'call', None, 'getInstance', None, 'SSLContext', '"TLSv1"', 1),
            (7, 'var', 'SSLContext', 'c', 'SSLContext.getInstance("SSLv3")', None, None, None),
            (7, 'call', None, 'getInstance', None, 'SSLContext', '"SSLv3"', 1),
        ),
        ((7, 'S25', ""),),
    ),
    (
        '        f.newDocumentBuilder();\n        f.newDocument();',
        (
            (6, 'call', None, 'newDocumentBuilder', None, 'f', None, 0),
            (7, 'call', None, 'newDocument', None, 'f', None, 0),
        ),
        ((6, 'S27', ""),),
    ),
    (
        '        File.createTempFile("a", arg);\n        Files.readString(arg);',
        (
            (6, 'call', None, 'createTempFile', None, 'File', '"a"', 2),
            (7, 'call', None, 'readString', None, 'Files', 'arg', 1),
        ),
        ((6, 'S28', ""),),
    ),
    (
        '        TrustManager[] all = { new X509TrustManager() {\n            public void checkServerTrusted(X509Certificate[] c, String t) {\n            }\n        } };',
        (
            (6, 'var', 'TrustManager[]', 'all', '{ new X509TrustManager() { public void checkServerTrusted(X509Certificate[] c, String t) { } } }', None, None, None),
            (7, 'method', None, 'checkServerTrusted', None, None, None, None),
        ),
        ((5, 'S22', ""),),
    ),
)

#: Files that one task lexes and judges, at most.
FILES_OF_A_TASK = 20_000

ORDER_FILES = Derivation(
    "orders",
    {
        "repo": "'repo-' || CAST(o_custkey % 10 AS STRING)",
        "path": "'src/main/Order' || CAST(o_orderkey AS STRING) || '.java'",
        "content": filled("java", o="o_orderkey"),
    },
    f"o_orderkey % {len(SOURCES)}",
    tuple((_FILE_HEAD + body + _FILE_TAIL,) for body, _, _ in SOURCES),
    ("java",),
    dealt=FILES_OF_A_TASK,
)

#: A document's text within a text block: backslashes and quotes escaped.
QUOTED = "replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"

#: A whole document as a comment and again as a text block, with code between and after.
DOCUMENT_FILES = Derivation(
    "documents",
    {
        "repo": "source",
        "path": "'src/Doc' || CAST(doc_id AS STRING) || '.java'",
        "content": (
            "'class D { /* \n' || replace(text, '*/', '* /') || '\n */\n"
            "  String authToken = \"tok-' || CAST(doc_id AS STRING) || '\";\n"
            "  String note = \"\"\"\n' || " + QUOTED + " || '\n\"\"\";\n"
            "  String query = \"SELECT \" + note;\n}\n'"
        ),
    },
)

_DEPTH, _TYPES, _BLANKS = "CAST(1 + o_orderkey % 60 AS INT)", "CAST(1 + o_orderkey % 10 AS INT)", "CAST(o_orderkey % 40 AS INT)"
#: The same statements at any nesting and indentation.
NESTED = {
    "query": f"repeat('(', {_DEPTH}) || '\"SELECT a\" + x' || repeat(')', {_DEPTH})",
    "index": f"repeat('a[', {_DEPTH}) || '0' || repeat(']', {_DEPTH}) || ' + y'",
    "type": f"repeat('List<', {_TYPES}) || 'String' || repeat('>', {_TYPES})",
}
NESTED_FILES = Derivation(
    "orders",
    {
        "path": "'src/N' || CAST(o_orderkey AS STRING) || '.java'",
        "content": (
            "'class N {\n  void m(String x) {\n    String query = ' || " + NESTED["query"] + " || ';\n    rt.exec(' || " + NESTED["index"]
            + " || ');\n    ' || " + NESTED["type"] + " || ' sql = x;\n    java.util.\n' || repeat(' ', " + _BLANKS + ") || 'Random r = new Random();\n    ' || repeat('{ ', "
            + _DEPTH + ") || 'int deep = 1;' || repeat(' }', " + _DEPTH + ") || '\n  }\n  N()\n' || repeat(' ', " + _BLANKS + ") || '{ }\n}\n'"
        ),
    },
    dealt=FILES_OF_A_TASK,
)

#: Order files of which some have no content, in one repository, or no end, in another.
BROKEN = "(o_custkey % 10 = 0 AND o_orderkey % 7 = 1 OR o_custkey % 10 = 1 AND o_orderkey % 7 = 2)"
BROKEN_FILES = Derivation(
    ORDER_FILES.table,
    ORDER_FILES.columns | {"content": f"CASE WHEN {BROKEN} THEN CASE o_custkey % 10 WHEN 1 THEN 'class A {{ String a = \"open; }}' END ELSE {ORDER_FILES.columns['content']} END"},
    ORDER_FILES.index,
    ORDER_FILES.templates,
    ORDER_FILES.names,
    dealt=FILES_OF_A_TASK,
)

# --- runtime events, from events ----------------------------------------------------

_USER = "CAST(user_id AS STRING)"
EVENT_COLUMNS = {
    "event_id": "CAST(event_id AS STRING)",
    "ts": "CAST(ts AS TIMESTAMP)",
    "event_type": (
        "CASE event_type WHEN 'click' THEN 'API_CALL' WHEN 'view' THEN 'FILE_ACCESS' "
        "WHEN 'purchase' THEN 'NETWORK_REQUEST' WHEN 'error' THEN 'RUNTIME_BEHAVIOR' "
        "ELSE 'AUTHENTICATION' END"
    ),
    "source": "'app-' || " + _USER,
    "class_name": pick(
        "user_id % 4",
        ["'java.lang.reflect.Method'", "'sun.misc.Unsafe'", "'java.util.List'",
         "'com.example.Service' || " + _USER],
    ),
    "method_name": pick("event_id % 3", ["'invoke'", "'nativeCopy'", "'get'"]),
    "path": pick(
        "event_id % 7",
        ["'/etc/passwd'", f"'/home/u' || {_USER} || '/.ssh/id_rsa'",
         f"'/home/u' || {_USER} || '/.aws/.env'", "'/tmp/x' || CAST(event_id AS STRING)",
         "'C:' || chr(92) || 'Windows' || chr(92) || 'System32' || chr(92) || 'a.dll'",
         "'/var/log/app.log'", "'/srv/.env'"],
    ),
    "operation": pick("event_id % 4", ["'READ'", "'WRITE'", "'DELETE'", "'LIST'"]),
    "protocol": pick("event_id % 4", ["'http'", "'HTTPS'", "'https'", "'ftp'"]),
    "host": pick(
        "user_id % 6",
        ["'localhost'", "'127.0.0.1'", f"'api{{u}}.example.com'".replace("{u}", "' || " + _USER + " || '"),
         "'evil' || " + _USER + " || '.ru'", "'cdn.example.ml'", "'shop.cn'"],
    ),
    "port": pick("event_id % 4", ["80", "443", "443", "21"]),
    "behaviour_type": pick(
        "event_id % 5",
        ["'Excessive Memory Allocation'", "'Rapid File Access'", "'Privilege Escalation Attempt'",
         "'PRIVILEGE_ESCALATION'", "'Normal'"],
    ),
    "location": "'host-' || " + _USER,
    "stack_trace": "'com.example.C' || " + _USER + " || '.run()'",
}
EVENTS = Derivation("events", EVENT_COLUMNS)


def _json(**fields: str) -> str:
    """JSON text of SQL expressions."""
    slash = "chr(92)"
    quoted = lambda x: f"replace(replace(replace({x}, {slash}, {slash} || {slash}), '\"', {slash} || '\"'), chr(10), {slash} || 'n')"
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":\"' || {quoted(v)} || '\"'" for k, v in fields.items()) + " || '}'"


_E = EVENT_COLUMNS
CHANGED_FILE = "'/src/C' || CAST(event_id AS STRING) || '.java'"
CHANGED_CODE = (
    "'class C {' || chr(10) || '  String password = \"p' || " + _USER + " || 'xyz\";' || chr(10) || "
    "'  Object c = Cipher.getInstance(\"DES\");' || chr(10) || CASE WHEN event_id % 30 = 0 THEN '' ELSE '}' END"
)
#: Kind and payload by the last digit of the id: all eight kinds, one that is unknown and none.
ENVELOPE_KINDS = (
    ("CODE_CHANGE", _json(path=CHANGED_FILE, content=CHANGED_CODE)),
    ("DEPENDENCY_UPDATE", _json(name="'lib-' || " + _USER, version="'1.0'")),
    ("RUNTIME_BEHAVIOR", _json(behaviour_type=_E["behaviour_type"], location=_E["location"])),
    ("API_CALL", _json(class_name=_E["class_name"], method_name=_E["method_name"], stack_trace=_E["stack_trace"])),
    ("FILE_ACCESS", _json(path=_E["path"], operation=_E["operation"], stack_trace=_E["stack_trace"])),
    ("NETWORK_REQUEST", _json(protocol=_E["protocol"], host=_E["host"], stack_trace=_E["stack_trace"])),
    ("AUTHENTICATION", _json(user=_USER)),
    ("AUTHORIZATION", _json(user=_USER, role="'admin'")),
    ("CONFIG_RELOAD", _json(path="'/etc/passwd'")),
    (None, "'[1, 2]'"),
)
_KIND = pick("event_id % 10", [f"'{k}'" if k else "CAST(NULL AS STRING)" for k, _ in ENVELOPE_KINDS])
#: Some payloads are cut off.
CUT_OFF = "event_id % 97 = 0"
ENVELOPES = Derivation(
    "events",
    {
        "event_id": "CAST(event_id AS STRING)", "ts": "CAST(ts AS TIMESTAMP)", "event_type": _KIND, "source": _E["source"],
        "payload": f"CASE WHEN {CUT_OFF} THEN '{{\"path\":' ELSE " + pick("event_id % 10", [p for _, p in ENVELOPE_KINDS]) + " END",
    },
)
#: What the payloads hold, without JSON: events that can be read, and the facts of their code.
ENVELOPE_EVENTS = Derivation("events", EVENT_COLUMNS | {"event_type": f"CASE WHEN {CUT_OFF} THEN NULL ELSE {_KIND} END"})
_CHANGED = f"FROM events WHERE event_id % 10 = 0 AND event_id % 30 <> 0 AND NOT {CUT_OFF}"
ENVELOPE_FACTS = " UNION ALL ".join(
    f"SELECT CAST(event_id AS STRING) AS repo, {CHANGED_FILE} AS path, {line} AS line, {n} AS ordinal, '{kind}' AS kind, {type_} AS type, {name} AS name, "
    f"{init} AS init, {scope} AS scope, {arg0} AS arg0, {n_args} AS n_args, CAST(NULL AS STRING) AS text {_CHANGED}"
    for line, n, kind, type_, name, init, scope, arg0, n_args in (
        (2, 0, "var", "'String'", "'password'", f"'\"p' || {_USER} || 'xyz\"'", "NULL", "NULL", "NULL"),
        (3, 1, "var", "'Object'", "'c'", "'Cipher.getInstance(\"DES\")'", "NULL", "NULL", "NULL"),
        (3, 0, "call", "NULL", "'getInstance'", "NULL", "'Cipher'", "'\"DES\"'", "1"),
    )
)


def events_of(kind: str, *columns: str) -> str:
    """SQL of one event kind."""
    return f"SELECT {', '.join(columns) or '*'} FROM ({EVENTS.sql}) AS e WHERE event_type = '{kind}'"


METRICS = Derivation(
    "events",
    {"ts": "CAST(ts AS TIMESTAMP)", "used": "value", "max": "CAST(500.0 AS DOUBLE)", "location": "'host-' || " + _USER},
)

# --- vulnerability feed, from documents ---------------------------------------------

_BACKSLASH = "chr(92)"
_JSON_TEXT = (
    f"replace(replace(replace(replace(replace(text, {_BACKSLASH}, {_BACKSLASH} || {_BACKSLASH}), "
    f"'\"', {_BACKSLASH} || '\"'), chr(10), {_BACKSLASH} || 'n'), chr(13), {_BACKSLASH} || 'r'), "
    f"chr(9), {_BACKSLASH} || 't')"
)
CVE_ID = "'CVE-2024-' || CAST(doc_id AS STRING)"
PUBLISHED = (
    "CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE '2024-0' || CAST(1 + doc_id % 9 AS STRING) "
    "|| '-1' || CAST(doc_id % 10 AS STRING) || 'T08:30:00.000' END"
)
SCORE = "CAST(n_chars % 101 AS DOUBLE) / 10.0"
CWES = ("CWE-89", "CWE-78", "CWE-79", "CWE-319", "CWE-798", "NVD-CWE-noinfo")


def _metric(name: str) -> str:
    return (
        "'{\"" + name + "\":[{\"cvssData\":{\"baseScore\":' || CAST(" + SCORE + " AS STRING) || '}}]}'"
    )


NVD_DOCUMENTS = Derivation(
    "documents",
    {
        "doc_id": "doc_id",
        "feed": (
            "'{\"vulnerabilities\":[{\"cve\":{\"id\":\"' || " + CVE_ID
            + " || '\",\"published\":\"' || " + PUBLISHED
            + " || '\",\"lastModified\":\"2024-12-31T00:00:00.000\",\"descriptions\":[{\"value\":\"' || "
            + _JSON_TEXT + " || '\"}],\"metrics\":' || "
            + pick(
                "doc_id % 5",
                [
                    _metric("cvssMetricV31"), _metric("cvssMetricV30"), _metric("cvssMetricV2"),
                    "'{}'", "'{\"cvssMetricV31\":[{\"cvssData\":{}}]}'",
                ],
            )
            + " || ',\"weaknesses\":[{\"description\":[{\"value\":\"' || "
            + pick("doc_id % 6", [f"'{c}'" for c in CWES])
            + " || '\"},{\"value\":\"CWE-20\"}]}],\"references\":[{\"url\":\"https://example.com/' "
            "|| CAST(doc_id AS STRING) || '\"},{\"url\":\"\"}]}}]}'"
        ),
    },
)

# --- dependencies and advisories, scanner reports, fix requests -----------------------

DEPENDENCIES = Derivation(
    "lineitem",
    {
        "repo": "'repo-' || CAST(l_suppkey AS STRING)",
        "name": "'lib-' || CAST(l_partkey AS STRING)",
        "version": "'1.' || CAST(CAST(l_quantity AS INT) AS STRING)",
    },
)
ADVISORIES = Derivation(
    "part",
    {
        "name": "'lib-' || CAST(p_partkey AS STRING)",
        "version": "'1.' || CAST(p_size AS STRING)",
        "cve_id": "'CVE-2024-' || CAST(p_partkey AS STRING)",
        "cvss": "CASE WHEN p_partkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_partkey % 101 AS DOUBLE) / 10.0 END",
        "description": "p_name",
    },
)

VIOLATIONS = Derivation(
    "lineitem",
    {
        "path": "'src/F' || CAST(l_orderkey AS STRING) || '.java'",
        "line": "CAST(l_linenumber AS INT)",
        "rule": "'Rule' || CAST(l_suppkey % 20 AS STRING)",
        "priority": pick("l_partkey % 5", ["'HIGH'", "'MEDIUM_HIGH'", "'MEDIUM'", "'MEDIUM_LOW'", "'LOW'"]),
        "level": "CAST(l_partkey % 5 AS INT)",
        "description": "'violation ' || CAST(l_partkey AS STRING)",
    },
)

#: (category, line) pairs covering every branch of every rewrite.
FIX_LINES = (
    ("SQL Injection", 'String q = "SELECT a{p}" + x;'),
    ("SQL Injection", 'String q = "select a{p}" + x;'),
    ("Hardcoded Credentials", 'String pw = "x{p}";'),
    ("Hardcoded Credentials", "String pw = f({p});"),
    ("Insecure Deserialization", "ObjectInputStream o{p} = f();"),
    ("Insecure Deserialization", "Object o = f({p});"),
    ("Path Traversal", 'File f = new File("a{p}" + b);'),
    ("Path Traversal", "File f = new File(a{p});"),
    ("Command Injection", 'Runtime.getRuntime().exec("a{p}" + b);'),
    ("Command Injection", "rt.exec(a{p});"),
    ("Cross-Site Scripting (XSS)", 'out.println("<p>{p}" + b);'),
    ("DOM-based XSS", "e.write(x{p});"),
    ("XXE Injection", "XMLReader r{p} = f();"),
    ("XML External Entity (XXE) Injection", "SAXParserFactory r{p} = f();"),
    ("Insecure Cryptography", 'getInstance("MD5"); // {p}'),
    ("Insecure Cryptography", 'getInstance("DES/ECB"); // {p}'),
    ("Insecure Cryptography", "Random r{p} = new Random();"),
    ("Insecure Cryptography", 'getInstance("AES/ECB"); // {p}'),
    ("Insecure Cryptography", "f({p});"),
    ("Weak Cryptographic Hash", 'getInstance("MD2"); // {p}'),
    ("Insecure Network Communication", 'new URL("http://a{p}")'),
    ("Insecure SSL/TLS Configuration", 'getInstance("TLSv1"); // {p}'),
    ("Weak TLS/SSL Protocol", 'getInstance("SSLv3"); // {p}'),
    ("Insecure Network Protocol", "new Socket(h, {p});"),
    ("Insecure Network Configuration", "   c.setHostnameVerifier(v{p});  "),
    ("Insecure Network Configuration", "TrustManager t{p} = f();"),
    ("Insecure SSL/TLS Configuration", "  void checkServerTrusted(int a{p}) { }"),
    ("Insecure SSL/TLS Configuration", "f({p});"),
    ("Code Injection", "eval(x{p});"),
)
FIX_REQUESTS = Derivation(
    "part",
    {
        "finding_id": "'f' || CAST(p_partkey AS STRING)",
        "path": "'P' || CAST(p_partkey AS STRING) || '.java'",
        "category": "category",
        "line_text": filled("line", p="p_partkey"),
        "location": (
            "CASE WHEN p_partkey % 17 = 0 THEN 'P.java:0' WHEN p_partkey % 19 = 0 THEN 'P.java:9' "
            "WHEN p_partkey % 23 = 0 THEN 'line 2' ELSE 'P.java:2' END"
        ),
        "content": "'class P {\n' || " + filled("line", p="p_partkey") + " || '\n}\n\n\n'",
    },
    f"(p_partkey * 5 + p_size) % {len(FIX_LINES)}",
    FIX_LINES,
    ("category", "line"),
)
