"""Evaluation datasets: corpus, queries and judgements from JSON lines or parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import judged_queries, normalized_qrels, relevant_first

# The public datasets that can be evaluated, with the split of their judgements and their language.
REGISTRY = {f"codesearchnet-{name}": ("test", name) for name in ("python", "javascript", "go", "ruby", "java", "php")} | {"cosqa": ("test", "python")}


@dataclass
class Dataset:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, lang) for k, (s, lang) in sorted(REGISTRY.items())], "dataset string, split string, language string")


def dataset_info(name: str) -> tuple[str, str] | None:
    """Split and language of a dataset of the registry, or null."""
    return REGISTRY.get(name)


# The columns of the parts; judgements may spell theirs in two ways.
PART_SCHEMAS = {
    "corpus": "_id string, text string, title string, partition string, language string",
    "queries": "_id string, text string, title string, partition string, language string",
    "qrels": "query_id string, `query-id` string, corpus_id string, `corpus-id` string, score double",
}


def read_rows(spark: SparkSession, path: str, part: str | None = None, split: str | None = None) -> DataFrame:
    """Rows of .jsonl files or of parquet, with their position; blank lines are dropped.

    With the name of a part its schema is given, so that JSON lines are read
    once. A folder of parquet may hold a folder or files for each split, of
    which `split` takes one; rows of a column `split` are filtered by it.
    """
    if path.endswith((".jsonl", ".json")):
        raw = spark.read.schema(PART_SCHEMAS[part]).json(path) if part else spark.read.json(path)
    else:
        raw = split_of(spark, path, split)
    return raw.withColumn("pos", F.monotonically_increasing_id())


def split_of(spark: SparkSession, path: str, split: str | None) -> DataFrame:
    """Parquet of one split: a folder of its name, files that begin with it, or rows whose column `split` has it."""
    if not split:
        return spark.read.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.getFileStatus(folder).isDirectory() else []
    if split in names:
        return spark.read.parquet(f"{path}/{split}")
    own = sorted(n for n in names if n.endswith(".parquet") and n[: -len(".parquet")].split("-")[0] == split)
    if own:
        return spark.read.parquet(*[f"{path}/{n}" for n in own])
    whole = spark.read.parquet(path)
    return whole.filter(F.col("split") == split) if "split" in whole.columns else whole.limit(0)


def is_cached(spark: SparkSession, folder: str) -> bool:
    """Whether a dataset's three parts are there and not empty."""
    from .files import file_size

    return all(file_size(spark, f"{folder}/{name}.jsonl") > 0 for name in PART_SCHEMAS)


def load(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, max_corpus: int | None = None, max_queries: int | None = None) -> Dataset:
    """The dataset with its corpus cut to max_corpus (relevant entries first) and queries that have a judged document.

    corpus and queries: _id, text, title where there is one, pos. Fails if a
    part is empty or a corpus id occurs twice.
    """
    judged = normalized_qrels(qrels if "pos" in qrels.columns else qrels.withColumn("pos", F.monotonically_increasing_id()), ["pos"])
    title = F.nullif(F.col("title"), F.lit("")) if "title" in corpus.columns else F.lit(None).cast("string")
    entries = corpus.select(F.col("_id").cast("string").alias("corpus_id"), F.coalesce("text", F.lit("")).alias("text"), title.alias("title"), "pos")
    if entries.groupBy("corpus_id").count().filter("count > 1").limit(1).count():
        raise ValueError("corpus ids are not unique")
    kept = relevant_first(entries, judged.filter("rel > 0"), max_corpus)
    asked = judged_queries(queries.select(F.col("_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), "pos"), judged, kept)
    if max_queries:
        asked = asked.orderBy("pos").limit(max_queries)
    for name, part in (("corpus", kept), ("queries", asked), ("qrels", judged)):
        if part.limit(1).count() == 0:
            raise ValueError(f"no {name}")
    return Dataset(kept, asked, judged)
