"""Risk model: features, scores, a classifier, and findings re-ranked by both."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.functions.severity import category_key, severity_weight
from sentrylane.functions.text import contains_any
from sentrylane.session import work_folder

# Words behind the two flags, impact by category, retrain threshold.
NETWORK_WORDS = ("network", "remote", "http", "api")
AUTH_WORDS = ("authentication", "authorization", "login")
IMPACT = {
    "SQL_INJECTION": 1.0,
    "REMOTE_CODE_EXECUTION": 1.0,
    "XSS": 0.8,
    "INSECURE_DESERIALIZATION": 0.8,
    "PATH_TRAVERSAL": 0.6,
    "XXE": 0.6,
    "INFORMATION_DISCLOSURE": 0.4,
}
DEFAULT_IMPACT = 0.2
RETRAIN_AFTER = 100


def network_reachable(description: Column) -> Column:
    return contains_any(F.lower(description), *NETWORK_WORDS)


def auth_required(description: Column) -> Column:
    return contains_any(F.lower(description), *AUTH_WORDS)


def base_score(severity: Column) -> Column:
    return severity_weight(severity) * 10.0


def impact(category: Column, normalise: bool = False) -> Column:
    """Impact of a category. Lookup is on the raw name, so display names such as
    ``SQL Injection`` take the default; ``normalise`` maps them to their key first."""
    key = category_key(category) if normalise else category
    table = F.create_map(*[F.lit(x) for pair in IMPACT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(DEFAULT_IMPACT))


def exploitability(network: Column, auth: Column, confidence: Column) -> Column:
    score = (
        F.when(network, 0.4).otherwise(0.0)
        + F.when(auth, 0.2).otherwise(0.4)
        + confidence * 0.3
    )
    return F.least(F.lit(1.0), score)


def cvss_like(exploit: Column, impact_: Column) -> Column:
    """Exploitability x impact x 10, rounded half up to one decimal, all in double."""
    return F.floor((exploit * impact_ * 10.0) * 10.0 + 0.5).cast("double") / 10.0


def adjust_severity(severity: Column, confidence: Column, exploit: Column) -> Column:
    """One step up when the model is sure and the finding exploitable; one step down
    when it is unsure and the finding is not."""
    up = (
        F.when(severity == "HIGH", "CRITICAL")
        .when(severity == "MEDIUM", "HIGH")
        .when(severity == "LOW", "MEDIUM")
        .otherwise(severity)
    )
    down = (
        F.when(severity == "CRITICAL", "HIGH")
        .when(severity == "HIGH", "MEDIUM")
        .when(severity == "MEDIUM", "LOW")
        .otherwise(severity)
    )
    return (
        F.when((confidence > 0.9) & (exploit > 0.8), up)
        .when((confidence < 0.5) & (exploit < 0.3), down)
        .otherwise(severity)
    )


def with_features(findings: DataFrame) -> DataFrame:
    """Add the model's inputs: ``network, auth, cvss`` next to category and confidence."""
    return findings.withColumns(
        {
            "network": network_reachable(F.col("description")),
            "auth": auth_required(F.col("description")),
            "cvss": base_score(F.col("severity")),
        }
    )


def with_scores(findings: DataFrame, normalise: bool = False) -> DataFrame:
    """Add exploitability, impact and the CVSS-like score (no model needed)."""
    return (
        with_features(findings)
        .withColumns(
            {
                "exploitability": exploitability(
                    F.col("network"), F.col("auth"), F.col("confidence")
                ),
                "impact": impact(F.col("category"), normalise),
            }
        )
        .withColumn("cvss_score", cvss_like(F.col("exploitability"), F.col("impact")))
    )


def feature_stages(category: str = "category") -> list:
    """One-hot category, confidence, two flags, base score. A category unseen in
    training falls on the indexer's extra slot, which the encoder drops: all zeros."""
    return [
        StringIndexer(inputCol=category, outputCol="category_ix", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["category_ix"], outputCols=["category_vec"], dropLast=True),
        VectorAssembler(
            inputCols=["category_vec", "confidence", "network_x", "auth_x", "cvss"],
            outputCol="features",
        ),
    ]


def _numeric_flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"network_x": F.col("network").cast("double"), "auth_x": F.col("auth").cast("double")}
    )


def train_classifier(rows: DataFrame, max_iter: int = 100, reg: float = 0.001) -> PipelineModel:
    """Multinomial logistic regression over labelled rows of the training schema.

    The category vocabulary is the only thing gathered on the driver; the fit itself is
    Spark's distributed optimiser. The model comes back from the shared folder: as fitted it
    holds the summary of its training and with it the session, which no task can be sent
    once the session has observed metrics.
    """
    labels = StringIndexer(inputCol="label", outputCol="label_ix", stringOrderType="alphabetAsc")
    fitted_labels = labels.fit(rows)
    stages = [
        fitted_labels,
        *feature_stages(),
        LogisticRegression(
            featuresCol="features", labelCol="label_ix", family="multinomial",
            maxIter=max_iter, regParam=reg,
        ),
        IndexToString(inputCol="prediction", outputCol="risk_level", labels=fitted_labels.labels),
    ]
    path = work_folder(rows.sparkSession, "model")
    Pipeline(stages=stages).fit(_numeric_flags(rows)).write().save(path)
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame, distribution: bool = False) -> DataFrame:
    """Add ``risk_level`` and ``risk_confidence``, the probability of that level.

    With ``distribution``, also the probability of every level as the map ``risk_distribution``.
    """
    # The label indexer is for training; findings to score have no label.
    stages = [s for s in model.stages if s.uid != model.stages[0].uid]
    kept = [F.col(c) for c in rows.columns]
    scored = PipelineModel(stages).transform(_numeric_flags(rows))
    levels = F.array(*[F.lit(level) for level in model.stages[0].labels])
    shares = vector_to_array("probability")
    added = [F.map_from_arrays(levels, shares).alias("risk_distribution")] if distribution else []
    return scored.select(*kept, "risk_level", F.array_max(shares).alias("risk_confidence"), *added)


def evaluate(model: PipelineModel, rows: DataFrame) -> tuple[float, DataFrame]:
    """Accuracy, and the confusion matrix as ``label`` by predicted level.

    Rows are scored once: both follow from the counts, at most one per label and level.
    """
    labels = model.stages[0].labels
    counts = {(r["label"], r["risk_level"]): r["count"] for r in predict(model, rows).groupBy("label", "risk_level").count().collect()}
    total = sum(counts.values())
    accuracy = sum(n for (label, level), n in counts.items() if label == level) / total if total else 0.0
    matrix = [(label, *[counts.get((label, level), 0) for level in labels]) for label in sorted({label for label, _ in counts}, key=str)]
    columns = ", ".join(f"`{level}` long" for level in labels)
    return accuracy, rows.sparkSession.createDataFrame(matrix, f"label string, {columns}")


def enrich(scored: DataFrame) -> DataFrame:
    """Fold ``risk_level, risk_confidence, exploitability`` into the finding.

    A row the model could not score (null level) keeps its own values.
    """
    done = F.col("risk_level").isNotNull()
    return scored.withColumns(
        {
            "severity": F.when(
                done,
                adjust_severity(
                    F.col("severity"), F.col("risk_confidence"), F.col("exploitability")
                ),
            ).otherwise(F.col("severity")),
            "description": F.when(
                done, F.concat("description", F.lit(" [ML Risk: "), "risk_level", F.lit("]"))
            ).otherwise(F.col("description")),
            "confidence": F.when(done, F.col("risk_confidence")).otherwise(F.col("confidence")),
            "auto_fix": F.when(done, F.col("exploitability") > 0.7).otherwise(F.col("auto_fix")),
        }
    )


def score_findings(findings: DataFrame, model: PipelineModel, normalise: bool = False) -> DataFrame:
    """Findings with model and hand-written scores folded in; a map-only plan."""
    columns = findings.columns
    # Category names differ between training rows and detectors, as the scores do.
    rows = with_scores(findings, normalise)
    if normalise:
        rows = rows.withColumn("shown", F.col("category")).withColumn("category", category_key(F.col("category")))
    scored = predict(model, rows)
    if normalise:
        scored = scored.withColumn("category", F.col("shown"))
    return enrich(scored).select(
        *columns, "risk_level", "risk_confidence", "exploitability", "impact", "cvss_score"
    )


def should_retrain(scores: DataFrame, last_fit: Column, after: int = RETRAIN_AFTER) -> DataFrame:
    """One row: distinct findings scored since the last fit, and whether to refit."""
    return (
        scores.filter(F.col("scored_at") > last_fit)
        .agg(F.countDistinct("finding_id").alias("n_scored"))
        .withColumn("retrain", F.col("n_scored") > after)
    )
