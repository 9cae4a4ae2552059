"""Static detection rules S01-S28: predicates over code facts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.functions.text import contains_any, location, shorten_literal
from sentrylane.operators.facts import UNREAD
from sentrylane.operators.rules import Rule, explode_hits, finding_id, hits, rule_dimension

# Names that mark a variable as a credential.
CREDENTIAL_WORDS = (
    "password", "passwd", "pwd", "secret", "apikey", "api_key", "token", "key",
    "credential", "auth",
)

_c = F.col


def _joined_text() -> Column:
    """First argument is assembled from pieces."""
    return (_c("n_args") > 0) & contains_any(_c("arg0"), "+", "concat")


def _algorithm() -> Column:
    return F.when(
        (_c("name") == "getInstance") & (_c("n_args") > 0),
        F.upper(F.replace("arg0", F.lit('"'), F.lit(""))),
    )


def _type_or_init(type_word: str, init_word: str) -> Column:
    return _c("type").contains(type_word) | _c("init").contains(init_word)


def _credential_words() -> Column:
    words = F.array(*[F.lit(w) for w in CREDENTIAL_WORDS])
    return F.filter(words, lambda w: F.contains(F.lower("name"), w))


def _credential_detail(_: Column) -> Column:
    return F.concat(F.lower("name"), F.lit(" = "), shorten_literal(_c("init")))


# Category, severity, confidence, CWE, fixability, texts of each rule.
STATIC_RULES: tuple[Rule, ...] = (
    Rule(
        "S01", "var", "SQL Injection", "CRITICAL", 0.95, "CWE-89", True,
        "SQL query constructed with string concatenation - vulnerable to SQL injection",
        (
            "Use PreparedStatement with parameterized queries instead of string concatenation",
            "Never concatenate user input directly into SQL queries",
            "Consider using an ORM framework with built-in SQL injection protection",
        ),
        lambda: contains_any(F.lower("name"), "query", "sql")
        & contains_any(F.upper("init"), "SELECT", "INSERT", "UPDATE", "DELETE")
        & _c("init").contains("+"),
    ),
    Rule(
        "S02", "call", "SQL Injection", "CRITICAL", 0.98, "CWE-89", True,
        "SQL execution with concatenated query - critical SQL injection vulnerability",
        (
            "Use PreparedStatement with parameterized queries",
            "Implement input validation and sanitization",
            "Use ORM frameworks with built-in SQL injection protection",
        ),
        lambda: _c("name").isin("executeQuery", "executeUpdate", "execute") & _joined_text(),
    ),
    Rule(
        "S03", "var", "Hardcoded Credentials", "HIGH", 0.90, "CWE-798", True,
        "Hardcoded credential found: ",
        (
            "Store credentials in environment variables or secure vaults",
            "Use configuration management systems",
            "Never commit credentials to source control",
            "Consider using secrets management services",
        ),
        lambda: _c("init").startswith('"')
        & (F.length("init") > 3)
        & ~_c("init").contains("()"),
        keys=_credential_words,
        detail=_credential_detail,
    ),
    Rule(
        "S04", "var", "Insecure Deserialization", "HIGH", 0.85, "CWE-502", True,
        "ObjectInputStream usage detected - potential deserialization vulnerability",
        (
            "Validate object types before deserialization",
            "Use allowlist of acceptable classes",
            "Avoid deserializing untrusted data",
        ),
        lambda: _type_or_init("ObjectInputStream", "new ObjectInputStream"),
    ),
    Rule(
        "S05", "var", "Insecure Deserialization", "CRITICAL", 0.95, "CWE-502", True,
        "XMLDecoder usage detected - critical deserialization vulnerability",
        (
            "Avoid using XMLDecoder for untrusted data",
            "Use safer alternatives like JAXB or Jackson",
        ),
        lambda: _type_or_init("XMLDecoder", "new XMLDecoder"),
    ),
    Rule(
        "S06", "call", "Insecure Deserialization", "HIGH", 0.80, "CWE-502", False,
        "Potential insecure deserialization vulnerability",
        (
            "Validate and sanitize serialized data",
            "Use allowlist-based deserialization filters",
            "Consider using JSON or XML instead of Java serialization",
        ),
        lambda: (_c("name") == "readObject") & _c("scope").contains("ObjectInputStream"),
    ),
    Rule(
        "S07", "call", "Command Injection", "CRITICAL", 0.98, "CWE-78", True,
        "Command execution with string concatenation - critical command injection vulnerability",
        (
            "Never concatenate user input into shell commands",
            "Use parameterized command execution with ProcessBuilder",
            "Implement strict input validation and allowlisting",
            "Avoid shell execution when possible",
        ),
        lambda: (_c("name") == "exec") & _joined_text(),
    ),
    Rule(
        "S08", "call", "Code Injection", "CRITICAL", 0.95, "CWE-94", True,
        "Dynamic code execution detected - can execute arbitrary code",
        (
            "Avoid dynamic code execution with user input",
            "Use safer alternatives or sandboxing",
            "Implement strict input validation",
        ),
        lambda: _c("name") == "eval",
    ),
    Rule(
        "S09", "var", "Command Injection", "HIGH", 0.85, "CWE-78", True,
        "ProcessBuilder with string concatenation - potential command injection",
        (
            "Use ProcessBuilder with separate arguments",
            "Validate and sanitize all inputs",
            "Avoid shell invocation",
        ),
        lambda: _c("type").contains("ProcessBuilder") & _c("init").contains("+"),
    ),
    Rule(
        "S10", "call", "Cross-Site Scripting (XSS)", "CRITICAL", 0.90, "CWE-79", True,
        "HTML output with unsanitized user input - XSS vulnerability",
        (
            "Encode all user input before outputting to HTML",
            "Use OWASP Java Encoder or similar libraries",
            "Implement Content Security Policy (CSP)",
            "Never trust user input in HTML context",
        ),
        lambda: _c("name").isin("println", "print", "write")
        & (_c("n_args") > 0)
        & _c("arg0").contains("+")
        & contains_any(_c("arg0"), "<", "html", "script"),
    ),
    Rule(
        "S11", "call", "DOM-based XSS", "HIGH", 0.75, "CWE-79", True,
        "Direct DOM manipulation - potential DOM-based XSS",
        (
            "Sanitize all data before inserting into DOM",
            "Use textContent instead of innerHTML when possible",
            "Implement proper output encoding",
        ),
        lambda: _c("name").isin("innerHTML", "innerText"),
    ),
    Rule(
        "S12", "var", "Cross-Site Scripting (XSS)", "HIGH", 0.85, "CWE-79", True,
        "HTML string constructed with concatenation - potential XSS",
        (
            "Use template engines with auto-escaping",
            "Encode all user data before inserting into HTML",
            "Avoid building HTML with string concatenation",
        ),
        lambda: contains_any(_c("init"), "<html", "<div", "<script", "<a href")
        & _c("init").contains("+"),
    ),
    Rule(
        "S13", "var", "XML External Entity (XXE) Injection", "HIGH", 0.90, "CWE-611", True,
        "DocumentBuilderFactory without secure configuration - XXE vulnerability",
        (
            "Disable external entity processing: factory.setFeature(XMLConstants.FEATURE_SECURE_PROCESSING, true)",
            "Disable DOCTYPE declarations",
            "Use secure XML parsing libraries",
        ),
        lambda: _type_or_init("DocumentBuilderFactory", "DocumentBuilderFactory.newInstance"),
    ),
    Rule(
        "S14", "var", "XML External Entity (XXE) Injection", "HIGH", 0.90, "CWE-611", True,
        "SAXParserFactory without secure configuration - XXE vulnerability",
        (
            "Disable external entity processing",
            "Set secure features on parser factory",
            "Use JAXB or other secure alternatives",
        ),
        lambda: _type_or_init("SAXParserFactory", "SAXParserFactory.newInstance"),
    ),
    Rule(
        "S15", "var", "XML External Entity (XXE) Injection", "HIGH", 0.85, "CWE-611", True,
        "XMLReader without secure configuration - XXE vulnerability",
        (
            "Configure XMLReader with secure features",
            "Disable external entity resolution",
        ),
        lambda: _type_or_init("XMLReader", "XMLReader"),
    ),
    Rule(
        "S16", "call", "Weak Cryptographic Hash", "CRITICAL", 0.95, "CWE-327", True,
        "MD5 hash algorithm is cryptographically broken",
        (
            "Use SHA-256 or SHA-3 for hashing",
            "For passwords, use bcrypt, scrypt, or Argon2",
            "MD5 is vulnerable to collision attacks",
        ),
        lambda: _algorithm().isin("MD5", "MD2"),
    ),
    Rule(
        "S17", "call", "Weak Cryptographic Hash", "HIGH", 0.90, "CWE-327", True,
        "SHA-1 hash algorithm is deprecated and weak",
        (
            "Use SHA-256, SHA-384, or SHA-512 instead",
            "SHA-1 is vulnerable to collision attacks",
        ),
        lambda: _algorithm().isin("SHA1", "SHA-1"),
    ),
    Rule(
        "S18", "call", "Weak Encryption Algorithm", "CRITICAL", 0.98, "CWE-327", True,
        "DES encryption is cryptographically broken",
        (
            "Use AES-256 encryption instead",
            "DES has 56-bit key and is easily brute-forced",
            "Never use DES in production",
        ),
        lambda: _algorithm() == "DES",
    ),
    Rule(
        "S19", "call", "Insecure Cipher Mode", "HIGH", 0.90, "CWE-327", True,
        "ECB mode is insecure - reveals patterns in encrypted data",
        (
            "Use GCM or CBC mode instead of ECB",
            "ECB does not provide semantic security",
            "Use authenticated encryption (AES-GCM)",
        ),
        lambda: _algorithm().contains("ECB"),
    ),
    Rule(
        "S20", "call", "Weak Random Number Generator", "HIGH", 0.85, "CWE-338", True,
        "java.util.Random is not cryptographically secure",
        (
            "Use SecureRandom instead of Random",
            "java.util.Random is predictable",
            "Use SecureRandom for security-sensitive operations",
        ),
        lambda: (_c("scope") == "Random") & _c("name").isin("nextInt", "nextLong"),
    ),
    Rule(
        "S21", "var", "Weak Random Number Generator", "MEDIUM", 0.80, "CWE-338", False,
        "Using java.util.Random - not cryptographically secure",
        (
            "Use SecureRandom for cryptographic operations",
            "Random is predictable and unsuitable for security",
        ),
        lambda: _c("type").contains("Random")
        & ~_c("type").contains("SecureRandom")
        & _c("init").contains("new Random"),
    ),
    Rule(
        "S22", "method", "Insecure SSL/TLS Configuration", "CRITICAL", 0.98, "CWE-295", True,
        "Accepting all SSL certificates - defeats SSL/TLS security",
        (
            "Never disable certificate validation",
            "Use proper certificate validation",
            "This enables man-in-the-middle attacks",
        ),
        lambda: _c("text").contains("X509TrustManager")
        & contains_any(_c("text"), "checkClientTrusted", "checkServerTrusted")
        & _c("text").rlike(r"\{\s*\}"),
        words=("X509TrustManager",),
    ),
    Rule(
        "S23", "method", "Insecure SSL/TLS Configuration", "HIGH", 0.95, "CWE-297", True,
        "Hostname verification disabled - vulnerable to MITM attacks",
        (
            "Enable hostname verification",
            "Validate SSL certificate hostnames",
            "Disabling verification allows MITM attacks",
        ),
        lambda: _c("text").contains("HostnameVerifier") & _c("text").contains("return true"),
        words=("HostnameVerifier",),
    ),
    Rule(
        "S24", "var", "Insecure Network Communication", "CRITICAL", 0.95, "CWE-319", True,
        "Using HTTP instead of HTTPS - data transmitted in cleartext",
        (
            "Always use HTTPS for sensitive data",
            "HTTP traffic can be intercepted and modified",
            "Implement TLS/SSL for all network communication",
        ),
        lambda: _c("type").contains("URL")
        & _c("init").contains('"http://')
        & ~_c("init").contains("localhost"),
    ),
    Rule(
        "S25", "var", "Weak TLS Version", "HIGH", 0.90, "CWE-327", True,
        "Using outdated TLS/SSL version - vulnerable to attacks",
        (
            "Use TLS 1.2 or TLS 1.3",
            "TLS 1.0/1.1 and SSL are deprecated",
            "Update to modern cryptographic protocols",
        ),
        lambda: contains_any(_c("init"), 'TLSv1"', "SSLv3", 'SSL"'),
    ),
    Rule(
        "S26", "var", "Unencrypted Socket Communication", "MEDIUM", 0.75, "CWE-319", False,
        "Using plain Socket without encryption",
        (
            "Use SSLSocket for encrypted communication",
            "Plain sockets transmit data in cleartext",
            "Implement TLS for socket communication",
        ),
        lambda: (_c("type") == "Socket") & _c("init").contains("new Socket"),
    ),
    Rule(
        "S27", "call", "XML External Entity (XXE)", "HIGH", 0.85, "CWE-611", True,
        "Potential XXE vulnerability: XML parser without secure configuration",
        (
            "Disable external entity processing",
            "Set secure features on XML parser",
            "Use secure XML parsing libraries",
        ),
        lambda: _c("name").isin("newDocumentBuilder", "newSAXParser"),
    ),
    Rule(
        "S28", "call", "Path Traversal", "MEDIUM", 0.70, "CWE-22", True,
        "Potential path traversal vulnerability: file operation with user input",
        (
            "Validate and sanitize file paths",
            "Use allowlist of permitted paths",
            "Implement path canonicalization",
        ),
        lambda: _c("scope").isin("File", "FileInputStream", "FileReader"),
    ),
)

#: A file that could not be read. Not a finding: ``aggregate.scan_results`` fails the scan for it.
UNREAD_RULE = Rule(
    "UNREAD", UNREAD, "Unreadable File", "INFO", 1.0, None, False, "File could not be read", (), lambda: F.lit(True)
)


def method_words(rules: Sequence[Rule]) -> tuple[str, ...] | None:
    """Words of which a file must hold one for any method rule of ``rules``; None: any file."""
    wanted = [r.words for r in rules if r.source == "method"]
    return None if None in wanted else tuple(w for words in wanted for w in words)


def static_dispatch(rules: Sequence[Rule] = STATIC_RULES) -> Column:
    """Hits of a fact, by its kind."""
    place = location(_c("path"), _c("line"))
    by_kind = [
        F.when(_c("kind") == kind, hits(chosen, place))
        for kind in ("var", "call", "method", UNREAD)
        if (chosen := [r for r in rules if r.source == kind])
    ]
    return F.coalesce(*by_kind)


def static_hits(
    facts: DataFrame, rules: Sequence[Rule] = STATIC_RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Which rules match which facts: one pass over ``facts``, no join."""
    return explode_hits(facts, static_dispatch(rules), [*keep, "path", "line", "ordinal"])


def static_findings(
    facts: DataFrame,
    rules: Sequence[Rule] = STATIC_RULES,
    detected_at: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Code facts to findings. ``detected_at`` is a job argument, null by default."""
    found = static_hits(facts, rules, keep)
    return found.join(rule_dimension(facts.sparkSession, rules), "rule_id").select(
        *keep,
        finding_id(
            _c("rule_id"), _c("path"), _c("line"), _c("ordinal"), _c("match_key")
        ).alias("finding_id"),
        (F.lit(None) if detected_at is None else detected_at)
        .cast("timestamp")
        .alias("detected_at"),
        "severity",
        "category",
        F.concat("rule_text", "detail").alias("description"),
        _c("place").alias("location"),
        "cwe_id",
        "confidence",
        "recommendations",
        "auto_fix",
        "rule_id",
        F.lit("STATIC_ANALYZER").alias("agent"),
        "path",
        "line",
        "match_key",
    )
