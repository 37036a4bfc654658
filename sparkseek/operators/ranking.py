"""Quality of rankings against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS, RECALL_CUTS = (1, 5, 10), (1, 5, 10, 100)


def per_query(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row for each judged query that was ranked: reciprocal ranks, DCG, ideal DCG and hits at every cut.

    ranked: query_id, corpus_id, rank, a document once a query; qrels: query_id, corpus_id, rel (several
    judgements of a pair: the greatest). A document without judgement has
    relevance 0; relevant is rel > 0. Nulls in ids are left out.
    """
    judged = qrels.dropna(subset=["query_id", "corpus_id"]).groupBy("query_id", "corpus_id").agg(F.max(F.coalesce("rel", F.lit(1.0))).alias("rel"))
    hits = ranked.select("query_id", "corpus_id", "rank").dropna().join(judged, ["query_id", "corpus_id"], "left").fillna(0.0, ["rel"])
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    r, k = F.col("rel"), F.col("rank")
    found = hits.groupBy("query_id").agg(
        *[F.min(F.when((r > 0) & (k <= c), k)).alias(f"first{c}") for c in CUTS],
        *[F.sum(F.when(k <= c, gain(r, k)).otherwise(0.0)).alias(f"dcg{c}") for c in CUTS],
        *[F.count_if((r > 0) & (k <= c)).alias(f"hits{c}") for c in RECALL_CUTS],
    )
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "corpus_id"))
    ideal = judged.withColumn("rank", ideal_rank).groupBy("query_id").agg(F.sum(F.when(r > 0, 1).otherwise(0)).alias("relevant"), *[F.sum(F.when(k <= c, gain(r, k)).otherwise(0.0)).alias(f"idcg{c}") for c in CUTS])
    return found.join(ideal, "query_id")


def metrics(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: mrr@1,5,10, ndcg@1,5,10, recall@1,5,10,100, rounded to 6 decimals; 0 where no query counts.

    MRR and NDCG average over all judged queries; recall leaves out queries
    without a relevant document.
    """
    q = per_query(ranked, qrels)
    cells = [F.avg(F.coalesce(1 / F.col(f"first{c}"), F.lit(0.0))).alias(f"mrr@{c}") for c in CUTS]
    cells += [F.avg(F.when(F.col(f"idcg{c}") > 0, F.col(f"dcg{c}") / F.col(f"idcg{c}")).otherwise(0.0)).alias(f"ndcg@{c}") for c in CUTS]
    cells += [F.avg(F.when(F.col("relevant") > 0, F.col(f"hits{c}") / F.col("relevant"))).alias(f"recall@{c}") for c in RECALL_CUTS]
    out = q.agg(*cells)
    return out.select(*[F.round(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), 6).alias(c) for c in out.columns])


def normalized_qrels(rows: DataFrame, position: list[str]) -> DataFrame:
    """query_id, corpus_id, rel from rows that spell columns query_id/query-id, corpus_id/corpus-id and score.

    Ids become strings, a missing id the empty string, a missing score 1; of
    several rows of a pair the last by `position` holds.
    """

    def either(name: str):
        spelled = [f"`{c}`" for c in (f"{name}_id", f"{name}-id") if c in rows.columns]
        return F.coalesce(*[F.col(c).cast("string") for c in spelled], F.lit(""))

    score = F.coalesce(F.col("score").cast("double"), F.lit(1.0)) if "score" in rows.columns else F.lit(1.0)
    keyed = rows.select(either("query").alias("query_id"), either("corpus").alias("corpus_id"), F.struct(*position, score.alias("rel")).alias("v"))
    return keyed.groupBy("query_id", "corpus_id").agg(F.max("v").alias("v")).select("query_id", "corpus_id", "v.rel")


def qrels_by_query(qrels: DataFrame) -> DataFrame:
    """query_id and a map of its judged documents to their relevance; a query's judgements are few beside the corpus."""
    pairs = F.collect_list(F.struct("corpus_id", "rel"))
    return qrels.dropna(subset=["query_id", "corpus_id"]).groupBy("query_id").agg(F.map_from_entries(F.sort_array(pairs)).alias("rels"))


def relevant_first(corpus: DataFrame, relevant: DataFrame, most: int | None) -> DataFrame:
    """All relevant entries, then others in order of position until `most`; corpus: corpus_id, pos; no limit if most is null or 0."""
    flagged = corpus.join(relevant.select("corpus_id").distinct().withColumn("is_rel", F.lit(True)), "corpus_id", "left").fillna(False, ["is_rel"])
    if not most:
        return flagged
    fill = flagged.filter("not is_rel")
    have = flagged.filter("is_rel")
    room = max(0, most - have.count())
    return have.unionByName(fill.orderBy("pos").limit(room))


def judged_queries(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Queries with at least one judged document (of any score) in the corpus."""
    return queries.join(qrels.join(corpus, "corpus_id", "left_semi"), "query_id", "left_semi")
