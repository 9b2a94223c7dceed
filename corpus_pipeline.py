"""The corpus pipeline: five stages over the documents, each written as Parquet and read again as the next one's input.

Language identification, near-duplicate removal, benchmark decontamination, redaction of personal data, and the
mixture of sources. Every stage but the last returns the columns of the documents it was given."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm import language_mix, pii, similarity, temperature, tiling
from sextant.llm.common import fold, kept, shared_dir, swept, table

#: Languages to keep; None keeps all that the model knows.
WANTED: tuple[str, ...] | None = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that language identification gives `und` go (no text, or no letter in it), and so
    do those whose language isn't among WANTED, if that names any. A null `lang` becomes the language found.

    The model is learned from the documents' own `lang`, outside fold 0 of 5. Rows that share a doc_id are judged one
    by one; a row without a letter goes and a row with one stays, whatever its other columns hold."""
    model = language_mix.fit(docs.filter(fold(F.col("doc_id"), 5) != 0))
    return language_mix.keep_identified(docs, model, WANTED)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id.

    Rows are near duplicates by five-word shingles and a similarity of 0.8. Of rows that share the doc_id that stays the
    one with the smallest text stays, nulls last; rows without a word are no duplicates of each other; a row without a
    doc_id stays as it is. Only ids are compared with all rows: no text is shuffled while the ids that go are few."""
    found = kept(similarity.linked(docs.filter(F.col("doc_id").isNotNull()), similarity.JaccardRules(words=5, percent=80)), "pipeline-components")
    gone = kept(found.filter("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    again = kept(found.filter("component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*docs.columns))
    place = f"_place_{uuid.uuid4().hex}"
    one = left.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; see tiling.clean for nulls, empty texts and ties."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data in the text replaced by its kind; see pii.redact."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the documents' sources: see temperature.mix for its columns and for nulls and ties."""
    return temperature.mix(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("mixture", mixed),
]

#: Language model, boosted trees and string tiling are beyond SQL: run() is tested against a brute-force version.
ORACLE_SQL = None


def stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each stage's output by name, read from its table in the shared folder: all stages, in order, over the documents of
    sf_dir. The texts to train on are those of the stage before the mixture, which tells how often and in which order."""
    at, docs, out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), {}
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        with swept(spark):
            found.write.parquet(f"{at}/{name}")
        docs = out[name] = spark.read.schema(found.schema).parquet(f"{at}/{name}")
    return out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; see `stages` for all of them."""
    return stages(spark, sf_dir)[STAGES[-1][0]]
