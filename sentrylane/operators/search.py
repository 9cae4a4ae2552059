"""Keyword search over CVE descriptions by an inverted index.

The index is three tables below one folder: ``records`` in order, newest first, each with
its place ``at`` in that order; ``postings``, per word and segment of the order the sorted
places of the records that hold the word; and ``words``, every word once. A search looks its
terms up among the words, reads the buckets of the words found and intersects their places:
the descriptions are not read.
"""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Places of a segment: no list of a word is longer.
SEGMENT = 1 << 16
#: Folders that the words are spread over, unless told otherwise. A search reads those of its words.
BUCKETS = 64

#: Stated, as an index of nothing has no file to tell it.
_POSTINGS = "word string, segment bigint, places array<bigint>, bucket int"

_c = F.col


def _words(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    parts = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def write_index(cves: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``cves(cve_id, description, published, ...)`` to ``path``.

    The order is by date, newest first, records without one last, then by id. Its places
    ascend with gaps: they come from the number of the sorted partition and the row in it,
    and are written before anything is built on them. A word in most records is one row a
    segment, so no list outgrows ``SEGMENT``, and its bucket is split over several tasks.
    """
    spark = cves.sparkSession
    ordered = cves.orderBy(_c("published").desc(), "cve_id").withColumn("at", F.monotonically_increasing_id())
    ordered.write.parquet(f"{path}/records")
    held = spark.read.parquet(f"{path}/records").select("at", F.explode(_words(_c("description"))).alias("word"))
    lists = (
        held.groupBy("word", F.floor(_c("at") / SEGMENT).alias("segment"))
        .agg(F.sort_array(F.collect_list("at")).alias("places"))
        .withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    )
    lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word", "segment").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("word", "bucket").agg(F.sum(F.size("places")).alias("n")).write.parquet(f"{path}/words")


def search_index(spark: SparkSession, path: str, keyword: str, limit: int) -> DataFrame:
    """The newest ``limit`` records whose description holds every word of ``keyword``.

    As in ``search_cves``, a word is held where it stands within a longer one, so a term
    stands for all words that contain it: a place counts once its words cover every term.
    Without a word in ``keyword`` every record matches.
    """
    records = spark.read.parquet(f"{path}/records")
    terms = list(dict.fromkeys(keyword.lower().split()))
    if terms:
        held = [F.contains("word", F.lit(t)) for t in terms]
        names = [f"term_{i}" for i in range(len(terms))]
        words = (
            spark.read.parquet(f"{path}/words").filter(reduce(or_, held))
            .select("word", "bucket", *[h.alias(n) for h, n in zip(held, names)])
        )
        postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").select("word", "bucket", "places")
        places = postings.join(words, ["bucket", "word"]).select(F.explode("places").alias("at"), *names)
        covered = places.groupBy("at").agg(*[F.bool_or(n).alias(n) for n in names])
        found = covered.filter(reduce(and_, [_c(n) for n in names])).select("at").orderBy("at").limit(limit)
        records = records.join(found, "at")
    return records.orderBy("at").limit(limit).drop("at")
