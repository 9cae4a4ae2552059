"""Line fixes: per finding, a rewrite of the line it points at."""

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.functions.severity import parse_severity
from sentrylane.functions.text import contains_any, line_of_location, strip

_c = F.col

# Texts appended to or put in place of a line.
SQL_NOTE = " // TODO: Use PreparedStatement with ? placeholder"
CREDENTIAL_NOTE = " // SECURITY: Use System.getenv() or secure vault instead"
DESERIALIZATION_NOTE = " // SECURITY: Use JSON serialization (Jackson/Gson) instead"
PATH_NOTE = " // SECURITY: Validate and normalize path with Paths.get().normalize()"
COMMAND_NOTE = " // SECURITY: Use ProcessBuilder with String[] args, validate input"
XSS_NOTE = " // SECURITY: Use StringEscapeUtils.escapeHtml4() to encode output"
XXE_NOTE = " // SECURITY: Set XMLConstants.FEATURE_SECURE_PROCESSING and disable external entities"
CRYPTO_NOTE = " // SECURITY: Use strong cryptography (SHA-256, AES/GCM, SecureRandom)"
SOCKET_NOTE = " // SECURITY: Use SSLSocketFactory.getDefault().createSocket()"
TRUST_NOTE = " // SECURITY: Do NOT use custom TrustManagers that accept all certificates"
TLS_NOTE = " // SECURITY: Enable proper SSL/TLS validation"
VERIFIER_BLOCK = (
    "        // SECURITY FIX: Hostname verification MUST be enabled\n        // ",
    " // REMOVED - Use default verifier\n"
    "        // connection.setHostnameVerifier(HttpsURLConnection.getDefaultHostnameVerifier());",
)
CERTIFICATE_BLOCK = (
    "        // SECURITY FIX: Use default SSL certificate validation\n        // ",
    " // REMOVED - implement proper validation",
)
# Categories that share the network and TLS rewrite.
NETWORK_CATEGORIES = (
    "Insecure Network Protocol",
    "Insecure Network Configuration",
    "Insecure Network Communication",
    "Weak TLS/SSL Protocol",
    "Insecure SSL/TLS Configuration",
)

#: Detector categories whose name no rewrite uses, and the rewrite that fits them.
FIX_FAMILY = {
    "XML External Entity (XXE) Injection": "XXE Injection",
    "XML External Entity (XXE)": "XXE Injection",
    "Weak Cryptographic Hash": "Insecure Cryptography",
    "Weak Encryption Algorithm": "Insecure Cryptography",
    "Insecure Cipher Mode": "Insecure Cryptography",
    "Weak Random Number Generator": "Insecure Cryptography",
    "Weak TLS Version": "Weak TLS/SSL Protocol",
    "Unencrypted Socket Communication": "Insecure Network Protocol",
    "DOM-based XSS": "Cross-Site Scripting (XSS)",
}


def fix_family(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FIX_FAMILY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), category)


def _replace(line: Column, old: str, new: str) -> Column:
    return F.replace(line, F.lit(old), F.lit(new))


def _note(line: Column, condition: Column, note: str) -> Column:
    return F.when(condition, F.concat(line, F.lit(note)))


def fixed_line(category: Column, line: Column, strict: bool = False) -> Column:
    """The rewritten line, null where nothing applies or nothing changes.

    ``strict`` takes the category by its exact name; otherwise detector categories
    without a rewrite of their own use the one of their family.
    """
    family = category if strict else fix_family(category)
    has = lambda *words: contains_any(line, *words)
    crypto = (
        F.when(has("MD5", "MD2"), _replace(_replace(line, "MD5", "SHA-256"), "MD2", "SHA-256"))
        .when(has("DES") & ~has("AES"), _replace(line, "DES", "AES/GCM/NoPadding"))
        .when(has("new Random()"), _replace(line, "new Random()", "new SecureRandom()"))
        .when(has("ECB"), _replace(line, "ECB", "GCM"))
        .otherwise(F.concat(line, F.lit(CRYPTO_NOTE)))
    )
    around = lambda block: F.concat(F.lit(block[0]), strip(line), F.lit(block[1]))
    network = (
        F.when(has('"http://'), _replace(line, "http://", "https://"))
        .when(has('TLSv1"', "SSLv"), F.regexp_replace(line, "(TLSv1|SSLv[0-9])", "TLSv1.3"))
        .when(has("new Socket"), F.concat(line, F.lit(SOCKET_NOTE)))
        .when(has("setHostnameVerifier", "ALLOW_ALL"), around(VERIFIER_BLOCK))
        .when(has("TrustManager"), F.concat(line, F.lit(TRUST_NOTE)))
        .when(has("checkServerTrusted", "checkClientTrusted"), around(CERTIFICATE_BLOCK))
        .otherwise(F.concat(line, F.lit(TLS_NOTE)))
    )
    rewritten = (
        F.when(
            family == "SQL Injection",
            _note(line, has("+") & has("SELECT", "INSERT", "UPDATE", "DELETE"), SQL_NOTE),
        )
        .when(family == "Hardcoded Credentials", _note(line, has("=") & has('"'), CREDENTIAL_NOTE))
        .when(
            family == "Insecure Deserialization",
            _note(line, has("ObjectInputStream", "XMLDecoder"), DESERIALIZATION_NOTE),
        )
        .when(family == "Path Traversal", _note(line, has("new File") & has("+"), PATH_NOTE))
        .when(
            family == "Command Injection",
            _note(line, has("Runtime.getRuntime().exec", "ProcessBuilder"), COMMAND_NOTE),
        )
        .when(
            family == "Cross-Site Scripting (XSS)",
            _note(line, has("println", "print", "write"), XSS_NOTE),
        )
        .when(
            family == "XXE Injection",
            _note(line, has("DocumentBuilderFactory", "SAXParserFactory", "XMLReader"), XXE_NOTE),
        )
        .when(family == "Insecure Cryptography", crypto)
        .when(family.isin(*NETWORK_CATEGORIES), network)
    )
    return F.nullif(rewritten, line)


def source_lines(content: Column) -> Column:
    """Lines of a text; empty lines at its end do not count, and a text of nothing but
    line breaks has no lines."""
    return F.when(content.rlike(r"\A\n+\z"), F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(content, r"\n+\z", ""), "\n")
    )


def target_line(content: Column, line: Column) -> Column:
    """The 1-based ``line`` of a text, null when there is none."""
    return F.when(line > 0, F.get(source_lines(content), line - 1))


def _with_target(rows: DataFrame, content: str, target: Column) -> DataFrame:
    """Add ``lines``, ``target`` and the ``old_line`` there.

    They come out of a one-element explode, so later expressions and filters read them
    as columns: the optimiser would otherwise put the split in place of every mention.
    """
    lines = source_lines(_c(content))
    spot = F.struct(lines.alias("lines"), target.alias("target"))
    return rows.select("*", F.explode(F.array(spot)).alias("spot")).select(
        *rows.columns,
        "spot.lines",
        "spot.target",
        F.when(_c("spot.target") > 0, F.get("spot.lines", _c("spot.target") - 1)).alias("old_line"),
    )


def _rebuilt(new_line: Column) -> Column:
    """The text of ``lines`` with the target line replaced, null without a new line."""
    text = F.array_join(
        F.transform("lines", lambda line, i: F.when(i == _c("target") - 1, new_line).otherwise(line)),
        "\n",
    )
    return F.when(new_line.isNotNull(), text)


def fix_lines(findings: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Old and new line per finding that can be fixed.

    Files without findings stay where they are read, and of the others only the lines
    that findings point at leave their row. The join of findings is on (path, line), so a
    file with very many findings spreads over its lines instead of meeting in one task.
    """
    targets = findings.withColumn("target", line_of_location(_c("location"))).filter(_c("target") > 0)
    wanted = targets.groupBy("path").agg(F.collect_set("target").alias("targets"))
    text = files.join(wanted, "path").select("path", "targets", source_lines(_c("content")).alias("lines"))
    spots = F.transform("targets", lambda n: F.struct(n.alias("target"), F.get("lines", n - 1).alias("old_line")))
    lines = text.select("path", F.explode(spots).alias("spot")).select("path", "spot.*").filter(_c("old_line").isNotNull())
    return (
        targets.join(lines, ["path", "target"])
        .withColumn("new_line", fixed_line(_c("category"), _c("old_line"), strict))
        .filter(_c("new_line").isNotNull())
        .select("finding_id", "path", _c("target").alias("line"), "category", "old_line", "new_line")
    )


def fix_sources(findings: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Rewritten text per finding that can be fixed: its file's text meets only such findings."""
    fixable = fix_lines(findings.select("finding_id", "path", "category", "location"), files, strict)
    lines = source_lines(_c("content"))
    rebuilt = F.array_join(
        F.concat(F.slice(lines, F.lit(1), _c("line") - 1), F.array("new_line"), F.slice(lines, _c("line") + 1, F.size(lines))), "\n"
    )
    return fixable.join(files.select("path", "content"), "path").select("finding_id", "path", "category", "content", rebuilt.alias("fixed"))


def fix_responses(requests: DataFrame, strict: bool = True) -> DataFrame:
    """Answer fix requests ``(code, category, severity, description, location, has_finding)``.

    The backup name is the hash of the replaced text, so repeating a request gives the
    same answer.
    """
    missing = _c("code").isNull() | ~F.coalesce("has_finding", F.lit(False))
    named = requests.withColumns(
        {
            "category": F.coalesce("category", F.lit("Unknown")),
            "severity": parse_severity(F.coalesce("severity", F.lit("MEDIUM"))),
            "description": F.coalesce("description", F.lit("")),
            "location": F.coalesce("location", F.lit("")),
        }
    )
    others = [c for c in requests.columns if c not in ("code", "category", "severity", "description", "location", "has_finding")]
    answered = (
        _with_target(named, "code", line_of_location(_c("location")))
        .withColumn("new_line", F.when(~missing, fixed_line(_c("category"), _c("old_line"), strict)))
        .withColumn("fixed_code", _rebuilt(_c("new_line")))
    )
    success = _c("fixed_code").isNotNull()
    backup = F.concat(F.lit("backup_"), F.sha2("code", 256))
    return answered.select(
        *others,
        success.alias("success"),
        F.when(missing, "Missing code or finding")
        .when(~success, "Could not generate fix for this vulnerability")
        .alias("error"),
        F.when(success, _c("code")).alias("original_code"),
        "fixed_code",
        F.when(success, backup).alias("backup_id"),
        F.when(success, F.concat(F.lit("backups/"), backup, F.lit(".java"))).alias("backup_path"),
        F.when(success, F.struct("category", "severity", "description", "location")).alias("finding"),
    )
