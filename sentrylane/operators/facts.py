"""Code facts from Java text: declarations, calls and methods.

A file is one row and goes through one map stage: no shuffle, no collect. The helper
``functions/java_text.py`` splits texts into tokens and writes them as flat lines of
letters, one line per pair of brackets that can hold a fact. Declarations, calls and methods
are found on these lines by regular expressions, and put together by array expressions;
both run in the JVM.
The patterns repeat single characters only, so they neither backtrack nor recurse: depth,
length and layout of the text do not matter.
"""

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sentrylane.functions.java_text import shapes

#: Kind of the one row of a file that could not be read, where these are asked for.
UNREAD = "unread"

_INTEGERS = ("ordinal", "line", "n_args")
_FACT = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name in _INTEGERS else T.StringType())
        for name in ("ordinal", "kind", "line", "type", "name", "init", "scope", "arg0", "n_args", "text")
    ]
)
#: Bytes of letters and text in one Arrow batch, on its way in and on its way out.
_BYTES = 8 << 20
#: Spark's limit for the way in; without it a batch is 10,000 rows, whatever the length of their texts.
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

# Patterns over the letters of ``shape``. (Digits are spelt out in classes: Java looks up single characters
# in a table, but asks each range and named class.)
_ANY = "nrdchfkxytmw"
_DIGITS = "0123456789_"
_NUMBERS = f"[{_DIGITS}]++"
_ANGLES = rf"<{_NUMBERS}[~-]*+>"
_DIMENSIONS = rf"[\[\]{_DIGITS}]*+"
#: A word that can be a type, dotted names, type arguments with dotted names, dimensions.
_TYPE = rf"[wmt][.v{_DIGITS}]++(?:{_ANGLES}[.v{_DIGITS}]++)?+{_DIMENSIONS}"
#: From a type and a name to the end of the statement or the bracket.
_DECLARATION = rf"{_TYPE}[{_ANY}]{_NUMBERS}{_DIMENSIONS}[=,][^;!#\n]*+[;!#]"
_DECLARATOR = rf"^[{_ANY}]{_NUMBERS}{_DIMENSIONS}(?:=.+)?$"
#: A name and its bracket where the token before is no dot, word, number or the like, and no body follows.
_CALL = rf"[^wmkhfnxcytvaqJ\]@.>{_DIGITS}][{_DIGITS}]*+([wmkhf]{_NUMBERS}\({_NUMBERS})(?=\){_NUMBERS}[^{{Bh{_DIGITS}])"
#: A first link, or brackets that no word precedes, and everything that dots tie to it.
_INSIDE = rf"()\[\]IJ<>BC~{_DIGITS}-"
_CHAIN = (
    rf"(?![{_DIGITS}])(?:[^dkhfxytmwnva>)\]J{_DIGITS}][{_DIGITS}]*+(?=[(\[I]\d)|(?=[ndkhfxytmwsq]\d))"
    rf"((?:n{_NUMBERS})?+[dkhfxytmwsq(\[I]{_NUMBERS}[{_INSIDE}]*+\.[v.{_INSIDE}]*+)"
)
#: In a chain: the end of what stands before the dot, the name, its bracket.
_LINK = rf"_\d+_\d+_\d+\.{_NUMBERS}(?:{_ANGLES}{_NUMBERS})?+v{_NUMBERS}\({_NUMBERS}(?=\){_NUMBERS}(?![{{Bh]))"
#: After a statement, a body or an opening brace: annotations, modifiers, type, name, parameters and a body.
_METHOD = (
    rf"(?=[;}}\n])(?:;|\}}{_NUMBERS}|\n\{{)([@avmy.(){_DIGITS}]*+(?:{_ANGLES}{_NUMBERS})?+{_TYPE}[wmt]{_NUMBERS}"
    rf"\({_NUMBERS}\)[\[\]{_DIGITS}]++(?:h[^{{}};!#\n]*+)?+\{{{_NUMBERS})"
)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, and not copied where an inner lambda reads it."""
    return F.transform(F.array(value), then)[0]


def _int(numbers: Column, at: int) -> Column:
    return F.element_at(numbers, at).cast("int")


def _slice(binary: Column, first: Column, behind: Column) -> Column:
    return F.substring(binary, first + 1, behind - first).cast("string")


def _fact(*order: Column, **given: Column) -> Column:
    """A fact before it is numbered, by ``order``: bytes of the text."""
    fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _FACT.fields if f.name not in ("ordinal", "kind")]
    return F.struct(*[c.alias(f"order{k}") for k, c in enumerate(order)], *fields)


def _all(letters: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(letters, F.lit(pattern), F.lit(group))


def _numbers(tokens: Column) -> Column:
    """The numbers of tokens in a row. (``split`` would compile a pattern for every value.)"""
    return _all(tokens, r"\d++")


def _head(tokens: Column) -> Column:
    """The numbers of the first token: begin, end, place, line. (For one plain character, ``split`` needs no pattern.)"""
    return F.split(F.regexp_extract(tokens, rf"^.([{_DIGITS}]++)", 1), "_")


def _end(tokens: Column) -> Column:
    """The end of the last token, if it has numbers."""
    return F.regexp_extract(tokens, r"^.*_(\d++)_\d++_\d++$", 1).try_cast("int")


def _declarations(letters: Column, plain: Column) -> Column:
    """Every declared variable that has an initialiser."""

    def declared(found: Column) -> Column:
        begin = F.regexp_extract(found, r"^.(\d++)", 1).cast("int")
        type_ = F.struct(begin.alias("begin"), _end(F.regexp_extract(found, f"^{_TYPE}", 0)).alias("end"))
        parts = _all(F.regexp_extract(found, f"^{_TYPE}(.*).$", 1), "[^,~]++")
        ends = found.endswith(";") | found.endswith("!")
        known = _with(parts, lambda p: F.when(ends & F.forall(p, lambda x: x.rlike(_DECLARATOR)), F.filter(p, lambda x: x.contains("="))))
        return _with(type_, lambda t: F.transform(known, lambda x: variable(x, t)))

    def variable(part: Column, t: Column) -> Column:
        first = F.regexp_extract(part, r"^[^=]*+=\D(\d++)", 1).try_cast("int")
        return _with(
            _head(part),
            lambda n: _fact(
                t["begin"], _int(n, 1), line=_int(n, 4), type=_slice(plain, t["begin"], t["end"]),
                name=_slice(plain, _int(n, 1), _int(n, 2)), init=_with(first, lambda at: _slice(plain, at, _end(part))),
            ),
        )

    found = F.transform(_all(letters, _DECLARATION), declared)
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def _arguments(n: Column, plain: Column) -> dict[str, Column]:
    """From the numbers of an opening bracket, which end ``n``."""
    return {"n_args": _int(n, -3), "arg0": F.when(_int(n, -3) > 0, _slice(plain, _int(n, -2), _int(n, -1)))}


def _calls(letters: Column, plain: Column) -> Column:
    """Every call, its first argument and the expression that it is called on."""

    def alone(found: Column) -> Column:
        return _with(
            _numbers(found),
            lambda n: _fact(_int(n, -7), line=_int(n, 4), name=_slice(plain, _int(n, 1), _int(n, 2)), **_arguments(n, plain)),
        )

    def chained(chain: Column) -> Column:
        return _with(_head(chain), lambda head: F.transform(_all(chain, _LINK), lambda x: linked(x, head)))

    def linked(found: Column, head: Column) -> Column:
        return _with(
            _numbers(found),
            lambda n: _fact(
                _int(n, -7), line=_int(head, 4), scope=_slice(plain, _int(head, 1), _int(n, 1)),
                name=_slice(plain, _int(n, -11), _int(n, -10)), **_arguments(n, plain),
            ),
        )

    dotted = F.flatten(F.transform(_all(letters, _CHAIN, 1), chained))
    # A constructor by its full name is no call.
    dotted = F.filter(dotted, lambda x: ~(x["scope"].startswith("new ") & ~x["scope"].contains("(")))
    return F.concat(F.transform(_all(letters, _CALL, 1), alone), dotted)


def _methods(letters: Column, plain: Column, source: Column) -> Column:
    """Every method with a body; the text as it stands in the source."""

    def method(found: Column) -> Column:
        name = F.split(F.regexp_extract(found, rf"[wmt]({_NUMBERS})\(", 1), "_")
        behind = F.regexp_extract(found, r"(\d++)$", 1).cast("int")
        return _with(
            _head(found),
            lambda n: _fact(
                _int(n, 1), line=_int(n, 4), name=_with(name, lambda x: _slice(plain, _int(x, 1), _int(x, 2))), text=_slice(source, _int(n, 3), behind)
            ),
        )

    return F.transform(_all(letters, _METHOD, 1), method)


def _numbered(kind: str, facts: Column) -> Column:
    """Facts of one kind in the order of the text."""

    def numbered(x: Column, n: Column) -> Column:
        given = {"ordinal": n.cast("int"), "kind": F.lit(kind)}
        return F.struct(*[(given[f.name] if f.name in given else x[f.name]).alias(f.name) for f in _FACT.fields])

    return F.transform(F.sort_array(facts), numbered)


def _lettered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, the content, its laid-out text and its letters; null where it cannot be read."""
    schema = T.StructType(
        [*rows.schema.fields[:-1], T.StructField("_content", T.StringType()), T.StructField("_plain", T.BinaryType()), T.StructField("_letters", T.StringType())]
    )
    names = [f.name for f in schema.fields]
    if rows.sparkSession.conf.get(_LIMIT, None) is None:
        rows.sparkSession.conf.set(_LIMIT, str(_BYTES))

    def lettered(batches):
        for b in batches:
            plain, letters, size, done = [], [], 0, 0

            def batch() -> pa.RecordBatch:
                passed = b.slice(done, len(plain)).columns
                return pa.RecordBatch.from_arrays([*passed, pa.array(plain, pa.binary()), pa.array(letters, pa.string())], names=names)

            for laid, line in shapes(b.column(len(columns)).cast(pa.large_binary()).to_pylist()):
                plain.append(laid)
                letters.append(line)
                size += len(line or "") + len(laid or "")
                if size > _BYTES:
                    yield batch()
                    done += len(plain)
                    plain, letters, size = [], [], 0
            if plain:
                yield batch()

    return rows.mapInArrow(lettered, schema)


def extract_facts(
    files: DataFrame,
    keep: tuple[str, ...] = (),
    method_words: tuple[str, ...] | None = None,
    unread: bool = False,
) -> DataFrame:
    """``files(path, content)`` to the code-facts table; ``keep`` passes columns on.

    ``method_words`` are words of which a wanted method must contain one; files with
    none of them skip the methods. Leave it out to get every method. A file without
    content, or whose text is no Java (a literal without end, a bracket without partner),
    has no facts; with ``unread`` it gives one row of kind ``unread``.
    """
    columns = [*keep, "path"]
    rows = _lettered(files.select(*columns, "content"), columns)
    content, letters = F.col("_content"), F.col("_letters")
    wanted = letters
    if method_words is not None:
        wanted = F.when(reduce(lambda a, b: a | b, [content.contains(w) for w in method_words], F.lit(False)), letters).otherwise("")

    def facts(plain: Column) -> Column:
        methods = _with(content.cast("binary"), lambda source: _methods(wanted, plain, source))
        return F.concat(
            _numbered("var", _declarations(letters, plain)), _numbered("call", _calls(letters, plain)), _numbered("method", methods)
        )

    found = _with(F.col("_plain"), facts)
    if unread:
        row = F.struct(*[F.lit({"ordinal": 0, "kind": UNREAD}.get(f.name)).cast(f.dataType).alias(f.name) for f in _FACT.fields])
        found = F.when(letters.isNull(), F.array(row)).otherwise(found)
    return rows.select(*columns, F.inline(found))
