"""Rule tables and the single-pass evaluator shared by static and runtime rules.

A rule is a predicate plus the finding it emits. All rules over one input are put
into one array expression and exploded, so the input is read once however many rules
are active. What a rule emits is a row of a small dimension; it is looked up by a
join whose small side is a literal relation, which Spark broadcasts by its known size.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentrylane import schemas
from sentrylane.sources.dimensions import literal_table


@dataclass(frozen=True)
class Rule:
    rule_id: str
    source: str  # fact kind or event table the rule reads
    category: str
    severity: str
    confidence: float
    cwe_id: str | None
    auto_fix: bool
    description: str
    recommendations: tuple[str, ...]
    when: Callable[[], Column]
    #: Array of match keys, one finding each; None emits one finding, key ''.
    keys: Callable[[], Column] | None = field(default=None)
    #: Text added to the description, one value per row and key.
    detail: Callable[[Column], Column] | None = field(default=None)
    #: Where the finding points; None takes the evaluator's default.
    place: Callable[[], Column] | None = field(default=None)
    #: For rules over methods: words of which a method's file must hold one; None: any file.
    words: tuple[str, ...] | None = field(default=None)


_HIT = "struct<rule_id:string,match_key:string,detail:string,place:string>"


def hits(rules: Sequence[Rule], default_place: Column) -> Column:
    """Array of ``(rule_id, match_key, detail, place)`` over all ``rules``."""

    def hit(rule: Rule, key: Column) -> Column:
        return F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            key.cast("string").alias("match_key"),
            (rule.detail(key) if rule.detail else F.lit("")).alias("detail"),
            (rule.place() if rule.place else default_place).alias("place"),
        )

    def fan(rule: Rule) -> Column:
        return F.when(rule.when(), F.transform(rule.keys(), lambda k: hit(rule, k))).otherwise(
            F.array().cast(f"array<{_HIT}>")
        )

    plain = [F.when(r.when(), hit(r, F.lit(""))) for r in rules if r.keys is None]
    fans = [fan(r) for r in rules if r.keys is not None]
    parts = ([F.array_compact(F.array(*plain))] if plain else []) + fans
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def rule_dimension(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """What each rule emits, as a literal relation of ``len(rules)`` rows."""
    rows = [
        (r.rule_id, r.category, r.severity, r.confidence, r.cwe_id, r.auto_fix, r.description, r.recommendations)
        for r in rules
    ]
    return literal_table(spark, rows, schemas.RULE_OUTPUT)


def explode_hits(df: DataFrame, array: Column, columns: Sequence[str]) -> DataFrame:
    """``columns`` plus the hit fields, one row per hit."""
    # The outer explode keeps the optimiser from adding a size() filter that would
    # evaluate every predicate a second time below the projection.
    return (
        df.select(*columns, F.explode_outer(array).alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(*columns, "hit.*")
    )


def finding_id(*parts: Column) -> Column:
    """A stable id: the same input row and rule give the same id on every run."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
