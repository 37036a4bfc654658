"""Named queries over the test tables, with the SQL each is checked against.

Search queries are the rows whose id is divisible by 50, against all rows.
Averages, sums of doubles and scores are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..chunk.files import chunk_files
from ..embed.hashing import hashed_words
from ..functions import scalars as S
from ..operators import cache, enrich, folds, knn, merkle, ranking, snapshots, store
from ..operators.codefiles import whole_files
from ..session import checkpoint_dir, cut, table

Query = Callable[[SparkSession, str], DataFrame]
MAX_DEPTH = 16


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))
    return e.filter("corpus_id % 50 = 0").withColumnRenamed("corpus_id", "query_id"), e


def _ranked(s: SparkSession, d: str, k: int = 100) -> DataFrame:
    return knn.top_k(*_vectors(s, d), k)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label")


def _qrels(s: SparkSession, d: str) -> DataFrame:
    q, c = _labels(s, d).filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), _labels(s, d).withColumnRenamed("vec_id", "corpus_id")
    return q.join(c, "label").filter("query_id <> corpus_id").select("query_id", "corpus_id", F.lit(1.0).alias("rel"))


def _graded(s: SparkSession, d: str) -> DataFrame:
    """2 for the same label, 1 for the next one; queries of label 9 have no relevant document at all."""
    q = _labels(s, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    near = q.withColumn("label", F.explode(F.array(F.col("ql"), (F.col("ql") + 1) % 10)))
    rel = F.when(F.col("ql") == 9, 0.0).when(F.col("ql") == F.col("label"), 2.0).otherwise(1.0)
    return near.join(_labels(s, d).withColumnRenamed("vec_id", "corpus_id"), "label").filter("query_id <> corpus_id").select("query_id", "corpus_id", rel.alias("rel"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _metric(*columns: str) -> Query:
    return lambda s, d: ranking.metrics(_ranked(s, d), _qrels(s, d)).select(*[f"`{c}`" for c in columns])


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", "text").dropna()


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").select("file_path").dropna().distinct()


def _newest_leaves(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "merkle_nodes")
    newest = raw.groupBy("repo", "root_dir").agg(F.max("snapshot_no").alias("snapshot_no"))  # first, so that only these rows are sorted out
    return snapshots.snapshot_nodes(raw.join(newest, ["repo", "root_dir", "snapshot_no"], "left_semi")).filter("is_file").select("repo", "root_dir", "path", "hash")


def _results(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "search_results")
    return r.select(F.col("query_hash").alias("query_id"), F.col("point_id").alias("corpus_id"), "score", "searched_at", "search_id", "hit_rank")


def _normal(s: SparkSession, d: str) -> DataFrame:
    score = F.coalesce("score", F.lit(1.0))
    rows = _results(s, d).withColumn("score", score)
    return ranking.normalized_qrels(rows, ["searched_at", "search_id", "hit_rank"])


def _judged(s: SparkSession, d: str) -> DataFrame:
    corpus = table(s, d, "cache_entries").select(S.sha256_uuid(F.lower("content_hash")).alias("corpus_id")).distinct()
    return ranking.judged_queries(_results(s, d).select("query_id").distinct(), _normal(s, d), corpus)


def _subset(s: SparkSession, d: str) -> DataFrame:
    docs = _documents(s, d).select(F.col("doc_id").alias("corpus_id"), F.col("doc_id").alias("pos"), F.lower(F.trim("source")).alias("source"))
    return ranking.relevant_first(docs.drop("source"), docs.filter("source = 'readme'"), 500).select("corpus_id", "is_rel")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """The chunks' points, over which the points of all search results are put."""
    chunks = table(s, d, "code_chunks").select(S.sha256_uuid(F.col("chunk_id")).alias("point_id"), "file_path", "start_line", F.struct("loaded_at", "row_id").alias("o")).dropna(subset=["point_id"])
    hits = table(s, d, "search_results").filter("payload is not null").select("point_id", "payload.file_path", "payload.start_line", F.struct("searched_at", "search_id", "hit_rank", "payload.file_path", "payload.start_line").alias("o")).dropna(subset=["point_id"])
    first = store.upserted(chunks.limit(0).drop("o"), chunks, "point_id", "o")
    return store.upserted(first, hits, "point_id", "o")


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").groupBy(S.sha256_uuid(F.col("chunk_id")).alias("point_id")).agg(F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("places"))


def _tests_paths(s: SparkSession, d: str) -> DataFrame:
    return _paths(s, d).filter(F.col("file_path").startswith("tests/"))


def _hit_rows(s: SparkSession, d: str) -> DataFrame:
    """Two hits a document, and one in a file that isn't there."""
    docs = _texts(s, d).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("file_path"))
    ranges = F.array(F.struct(F.lit(1).alias("start_line"), F.lit(2).alias("end_line")), F.struct(F.lit(3).alias("start_line"), F.lit(400).alias("end_line")))
    return docs.select("file_path", F.inline(ranges)).unionByName(docs.select(F.concat("file_path", F.lit(".gone")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))


def _enriched(s: SparkSession, d: str) -> DataFrame:
    files = _texts(s, d).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    return enrich.with_lines(_hit_rows(s, d), files)


def _formatted(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    hits = _ranked(s, d, 5).join(e.select(F.col("vec_id").alias("corpus_id"), "label"), "corpus_id")
    shaped = hits.select(
        "query_id", "rank", F.concat(F.lit("vectors/"), F.col("label").cast("string")).alias("file_path"), F.lit(1).alias("start_line"), F.col("label").alias("end_line"), F.round("score", 2).alias("score"),
        F.when(F.col("label") % 2 == 0, F.concat(F.lit("s"), F.col("label").cast("string"))).alias("symbol_name"), F.concat(F.lit("id "), F.col("corpus_id").cast("string")).alias("content"),
    )
    return enrich.formatted(shaped, ["query_id"])


def _embedded(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    rows = table(s, d, name).select(key, "text").dropna()
    return hashed_words(rows, "text", 64).select(key, "vector")


def _semantic(s: SparkSession, d: str) -> DataFrame:
    q = _embedded(s, d, "eval_items", "item_id").withColumnRenamed("item_id", "query_id")
    c = _embedded(s, d, "documents", "doc_id").withColumnRenamed("doc_id", "corpus_id")
    return knn.top_k_blocked(q, c, 5, include_self=True, digits=6).select("query_id", "corpus_id", "score", "rank")


def _probe_counts(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "code_chunks").select("row_id", F.lower("content_hash").alias("content_hash")).dropna().distinct()
    entries = table(s, d, "cache_entries")
    parts = None
    for r in entries.select("model").dropna().distinct().orderBy("model").collect():  # one row a model
        counted = cache.probe(chunks, entries, r["model"]).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("vector").isNotNull()).alias("hits"), F.countDistinct(F.when(F.col("vector").isNull(), F.col("content_hash"))).alias("to_embed"))
        part = counted.select(F.lit(r["model"]).alias("model"), "*")
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else s.createDataFrame([], "model string, chunks long, hits long, to_embed long")


def _pruned(s: SparkSession, d: str) -> DataFrame:
    e = cache.latest_entries(table(s, d, "cache_entries"))
    newest = e.agg(F.max("ts")).first()[0]
    kept = cache.pruned(e, F.lit(newest), 90 * 86_400_000)
    return kept.select("model", "content_hash")


def _small_segments(s: SparkSession, d: str) -> DataFrame:
    sizes = F.transform(S.text_lines(F.col("text")), lambda x: F.ceil((F.length(x) + 1) / 4))
    return _texts(s, d).select("doc_id", F.inline(folds.merge_small(sizes, 64))).withColumnRenamed("start", "start_line").withColumnRenamed("end", "end_line")


def _packed(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", "text", F.inline(folds.pack_lines(S.text_lines(F.col("text")), 256))).withColumnRenamed("start", "start_line").withColumnRenamed("end", "end_line")


def _folder(s: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


def _remove(s: SparkSession, folder: str) -> None:
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _info(s: SparkSession, d: str) -> DataFrame:
    """What a collection of all chunk contents says of itself."""
    held = store.VectorStore(s, _folder(s, "collection"), 64, "none")
    held.ensure()
    held.commit(points=store.as_points(table(s, d, "code_chunks").select(F.col("chunk_id").alias("content_hash"), F.lit(None).cast("array<float>").alias("vector")).dropna(subset=["content_hash"])))
    info = held.info()
    held.drop()
    return s.createDataFrame([(info["points"], info["status"])], "points long, status string")


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    from ..sources.files import write_jsonl

    folder = _folder(s, "lines")
    write_jsonl(_documents(s, d).select("doc_id", "text", "lang"), folder)
    back = cut(s.read.schema("doc_id long, text string, lang string").json(folder))
    _remove(s, folder)
    return back


def _matrices(s: SparkSession, d: str) -> DataFrame:
    """Embeddings written as raw matrices and read again: ends and length of every vector."""
    from ..sources.files import read_matrix, write_matrix

    folder = _folder(s, "matrix")
    write_matrix(table(s, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")), folder)
    back = cut(read_matrix(s, folder, 64).select(F.col("vector")[0].cast("double").alias("first"), F.col("vector")[63].cast("double").alias("last"), F.size("vector").cast("long").alias("dims")))
    _remove(s, folder)
    return back


def _runs(s: SparkSession, d: str) -> list[tuple[str, dict]]:
    """Three runs of the indexer: all files, the same files again, and a set in which a third changed and a third left; then its stats."""
    from ..config import IndexConfig
    from .pipeline import Indexer

    files = cut(whole_files(table(s, d, "code_chunks")).filter(F.lower("file_path").rlike(r"\.tsx?$")).select(F.concat_ws("/", "repo", "root_dir", "file_path").alias("path"), "text"))
    hashed = files.withColumn("hash", F.sha2("text", 256))
    part = F.conv(F.substring(F.md5("path"), 1, 4), 16, 10).cast("int") % 3
    later = files.filter(part != 0).withColumn("text", F.when(part == 1, F.concat("text", F.lit("\nexport const added = 1;\n"))).otherwise(F.col("text"))).withColumn("hash", F.sha2("text", 256))
    indexer = Indexer(s, IndexConfig(index_dir=_folder(s, "index")))
    out = [(name, indexer.index(given)) for name, given in (("first", hashed), ("same", hashed), ("changed", later))]
    out.append(("stats", indexer.stats()))
    indexer.reset()
    return out


def _incremental(s: SparkSession, d: str) -> DataFrame:
    rows = [(name, got.get("total_files", got.get("files")), *[got.get(k, 0) for k in ("added", "modified", "removed", "failed_files")]) for name, got in _runs(s, d)]
    return s.createDataFrame(rows, "run string, total_files long, added long, modified long, removed long, failed_files long")


def _incremental_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = [(name, *[got.get(k, 0) for k in ("total_chunks", "new_chunks", "cached_chunks", "points", "cache_entries")]) for name, got in _runs(s, d)]
    return s.createDataFrame(rows, "run string, total_chunks long, new_chunks long, cached_chunks long, points long, cache_entries long")


def queries() -> dict[str, Query]:
    """Every query of the core by name."""
    every = [f"mrr@{k}" for k in (1, 5, 10)], [f"ndcg@{k}" for k in (1, 5, 10)], [f"recall@{k}" for k in (1, 5, 10, 100)]
    return {
        "p3_found": lambda s, d: snapshots.snapshot_changes(table(s, d, "merkle_nodes")),
        "snapshot_diff_counts": lambda s, d: snapshots.snapshot_changes(table(s, d, "merkle_nodes")).groupBy("repo", "root_dir", "status").agg(F.count(F.lit(1)).alias("files")),
        "merkle_build": lambda s, d: merkle.merkle_tree(_newest_leaves(s, d), ["repo", "root_dir"]).select("repo", "root_dir", "path", "hash", "is_file", F.size("children").cast("long").alias("n_children")),
        "merkle_root": lambda s, d: merkle.root_hash(merkle.merkle_tree(_newest_leaves(s, d), ["repo", "root_dir"]), ["repo", "root_dir"]),
        "parent_path_rollup": lambda s, d: _paths(s, d).groupBy(S.parent_path(F.col("file_path")).alias("parent")).agg(F.count(F.lit(1)).alias("files"), F.min("file_path").alias("first_file")),
        "knn_topk_bruteforce": lambda s, d: _rounded(_ranked(s, d)),
        "knn_blocked_matmul": lambda s, d: _rounded(knn.top_k_blocked(*_vectors(s, d), 100)).select("query_id", "corpus_id", "score", "rank"),
        "knn_single_query_topk": lambda s, d: _rounded(knn.nearest(_vectors(s, d)[1].withColumnRenamed("corpus_id", "id"), [1.0] * 16 + [0.0] * 32 + [-1.0] * 16)),
        "ir_mrr": _metric(*every[0]),
        "ir_ndcg": _metric(*every[1]),
        "ir_recall": _metric(*every[2]),
        "ir_all_metrics": lambda s, d: ranking.metrics(_ranked(s, d), _qrels(s, d)),
        "ir_graded_metrics": lambda s, d: ranking.metrics(_ranked(s, d), _graded(s, d).filter("rel > 0")),
        "ir_zero_relevant_queries": lambda s, d: ranking.metrics(_ranked(s, d), _graded(s, d)),
        "qrels_normalize_last_wins": lambda s, d: _normal(s, d).withColumn("rel", F.round("rel", 6)),
        "corpus_relevant_first_subset": _subset,
        "queries_with_judged_docs": _judged,
        "file_hash": lambda s, d: _texts(s, d).select("doc_id", S.content_hash(F.col("text")).alias("hash")),
        "point_uuid": lambda s, d: table(s, d, "code_chunks").select("chunk_id", S.sha256_uuid(F.col("chunk_id")).alias("point_id")).distinct(),
        "extension_filter": lambda s, d: _paths(s, d).filter(S.has_extension(F.col("file_path"), [".ts", ".TSX"])),
        "hidden_filter": lambda s, d: _paths(s, d).filter(~S.is_hidden(F.col("file_path"))),
        "language_detect": lambda s, d: _paths(s, d).select("file_path", S.file_extension(F.col("file_path")).alias("ext"), S.language(F.col("file_path")).alias("language")),
        "relative_path": lambda s, d: _paths(s, d).select("file_path", S.relative_path(F.col("file_path"), "src").alias("below_src")),
        "token_estimate": lambda s, d: _texts(s, d).select("doc_id", S.line_tokens(F.col("text")).alias("tokens")),
        "batch_token_estimate": lambda s, d: _texts(s, d).select("doc_id", S.batch_tokens(F.col("text")).alias("tokens")),
        "truncate_text": lambda s, d: _texts(s, d).select("doc_id", S.truncated(F.col("text"), 200).alias("head")),
        "line_split_chunks": lambda s, d: _packed(s, d).drop("text"),
        "chunk_content_hash": lambda s, d: _packed(s, d).select("doc_id", "start_line", S.content_hash(S.line_range(F.col("text"), F.col("start_line"), F.col("end_line"))).alias("hash")),
        "merge_small_segments": _small_segments,
        "token_budget_batches": lambda s, d: folds.token_batches(_texts(s, d).select(F.floor(F.col("doc_id") / 256).alias("run"), "doc_id", S.batch_tokens(F.col("text")).alias("tokens")), ["run"], "doc_id", "tokens", 2000, 24),
        "hash_embed": lambda s, d: _embedded(s, d, "documents", "doc_id").select("doc_id", F.posexplode("vector").alias("bucket", "w")).filter("w <> 0").select("doc_id", "bucket", F.round("w", 6).alias("weight")),
        "semantic_search_documents": _semantic,
        "cache_probe_hit_miss": _probe_counts,
        "cache_prune_ttl": _pruned,
        "cache_latest_entry": lambda s, d: cache.latest_entries(table(s, d, "cache_entries")).select("model", "content_hash", "ts", F.coalesce(F.size("vector"), F.lit(-1)).cast("long").alias("dims")),
        "cache_stats": lambda s, d: cache.stats(table(s, d, "cache_entries").withColumn("vector", F.coalesce("vector", F.array().cast("array<float>")))),
        "upsert_last_wins": _upserted,
        "delete_by_paths": lambda s, d: store.without(_points(s, d), _tests_paths(s, d), "file_path"),
        "delete_by_ids": lambda s, d: store.without(_points(s, d), table(s, d, "search_results").select("point_id"), "point_id"),
        "scroll_points": lambda s, d: store.scrolled(_points(s, d)),
        "collection_info": _info,
        "jsonl_round_trip": _json_lines,
        "matrix_round_trip": _matrices,
        "index_stats": lambda s, d: table(s, d, "code_chunks").agg(F.countDistinct("repo", "root_dir", "file_path").alias("total_files"), F.countDistinct("row_id").alias("total_chunks"), F.countDistinct("chunk_id").alias("distinct_contents")),
        "enrich_line_ranges": _enriched,
        "format_for_llm": _formatted,
        "format_bytes": lambda s, d: _documents(s, d).select("doc_id", S.byte_size((F.col("n_chars") * F.lit(997)).cast("long")).alias("size")),
        "result_bar_format": lambda s, d: _rounded(_ranked(s, d, 5)).select("query_id", "rank", S.percent_bar(F.greatest(F.round("score", 2), F.lit(0.0))).alias("bar")),
        "path_safe_names": lambda s, d: table(s, d, "code_chunks").select("repo", S.path_safe(F.concat_ws(":", "repo", "root_dir")).alias("safe")).distinct(),
        "ts_chunk_files": lambda s, d: chunk_files(whole_files(table(s, d, "code_chunks")).filter(F.lower("file_path").rlike(r"\.tsx?$")).select(F.concat_ws("/", "repo", "root_dir", "file_path").alias("file_path"), "text")),
        "incremental_index_run": _incremental,
        "incremental_index_chunks": _incremental_chunks,
    }


_RANKED = """with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 50 = 0),
c as (select vec_id corpus_id, embedding::double[] v from embeddings),
s as (select query_id, corpus_id, list_dot_product(q, v) score from q join c on query_id <> corpus_id),
r as (select *, row_number() over (partition by query_id order by score desc, corpus_id) as rank from s qualify rank <= {k})"""
_LABELED = """, j as (select a.vec_id query_id, b.vec_id corpus_id, {rel}::double rel from embeddings a join embeddings b on {on} where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id{more}),
h as (select r.query_id, r.corpus_id, r.rank, coalesce(j.rel, 0) rel from r left join j using (query_id, corpus_id) where r.query_id in (select query_id from j)),
i as (select query_id, rel, row_number() over (partition by query_id order by rel desc, corpus_id) rank from j),
f as (select query_id, {found} from h group by query_id),
g as (select query_id, count(*) filter (rel > 0) relevant, {ideal} from i group by query_id)
select {cells} from f join g using (query_id)"""


def _metrics_sql(parts: str, rel: str = "1", on: str = "a.label = b.label", more: str = "") -> str:
    found = ", ".join([f"min(rank) filter (rel > 0 and rank <= {k}) first{k}, sum(case when rank <= {k} then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) dcg{k}" for k in (1, 5, 10)] + [f"count(distinct corpus_id) filter (rel > 0 and rank <= {k}) hits{k}" for k in (1, 5, 10, 100)])
    ideal = ", ".join(f"sum(case when rank <= {k} then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) idcg{k}" for k in (1, 5, 10))
    cells = []
    if "m" in parts:
        cells += [f'round(coalesce(avg(coalesce(1.0 / first{k}, 0)), 0), 6) "mrr@{k}"' for k in (1, 5, 10)]
    if "n" in parts:
        cells += [f'round(coalesce(avg(case when idcg{k} > 0 then dcg{k} / idcg{k} else 0 end), 0), 6) "ndcg@{k}"' for k in (1, 5, 10)]
    if "r" in parts:
        cells += [f'round(coalesce(avg(case when relevant > 0 then hits{k} / relevant end), 0), 6) "recall@{k}"' for k in (1, 5, 10, 100)]
    return _RANKED.format(k=100) + _LABELED.format(rel=rel, on=on, more=more, found=found, ideal=ideal, cells=", ".join(cells))


_PATH = r"case when regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^(\./)+', ''), '(/\.?)+$', '') = '' then '.' else regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^(\./)+', ''), '(/\.?)+$', '') end"
_NODES = f"""with n as (select repo, root_dir, snapshot_no, {_PATH} path, lower(hash) hash, is_file, loaded_at from merkle_nodes),
l as (select repo, root_dir, snapshot_no, path, arg_max(hash, loaded_at) hash, arg_max(is_file, loaded_at) is_file from n group by all)"""
_DIFF = (
    _NODES
    + """, s as (select *, lag(snapshot_no) over (partition by repo, root_dir order by snapshot_no) b from (select distinct repo, root_dir, snapshot_no from l)),
f as (select * from l where is_file),
nw as (select s.repo, s.root_dir, s.snapshot_no, path, hash from f join s using (repo, root_dir, snapshot_no) where b is not null),
od as (select s.repo, s.root_dir, s.snapshot_no, path, hash from f join s on f.repo = s.repo and f.root_dir = s.root_dir and f.snapshot_no = s.b),
d as (select coalesce(nw.repo, od.repo) repo, coalesce(nw.root_dir, od.root_dir) root_dir, coalesce(nw.snapshot_no, od.snapshot_no) snapshot_no, coalesce(nw.path, od.path) path,
 case when od.hash is null then 'added' when nw.hash is null then 'removed' else 'modified' end status
 from nw full join od on nw.repo = od.repo and nw.root_dir = od.root_dir and nw.snapshot_no = od.snapshot_no and nw.path = od.path where nw.hash is distinct from od.hash)"""
)


def _tree_sql() -> str:
    """Levels of the tree from the deepest up, one query a level."""
    out = [_NODES + ", w as (select repo, root_dir, path, hash from l where is_file and snapshot_no = (select max(snapshot_no) from l m where m.repo = l.repo and m.root_dir = l.root_dir))"]
    depth = "len(string_split(path, '/'))"
    out.append(f"t{MAX_DEPTH + 1} as (select repo, root_dir, path, hash, true is_file, 0 n_children, {depth} d from w where false)")
    for level in range(MAX_DEPTH, 0, -1):
        here = f"(select * from t{level + 1} where d = {level} union all select repo, root_dir, path, hash, true, 0, {level} from w where {depth} = {level})"
        parent = "case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end"
        out.append(f"t{level} as (select repo, root_dir, {parent} path, sha256(string_agg(hash, '' order by hash)) hash, false is_file, count(distinct path) n_children, {level - 1} d from {here} group by 1, 2, 3)")
    union = " union all ".join([f"select repo, root_dir, path, hash, is_file, n_children from t{level}" for level in range(MAX_DEPTH, 0, -1)] + ["select repo, root_dir, path, hash, true, 0 from w"])
    return ", ".join(out) + f", nodes as ({union})"


_HASHED = """{a} as (select {key} id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) t from {table} where text is not null),
{b} as (select id, bucket, n / sqrt(sum(n * n) over (partition by id)) w from (select id, (('0x' || substr(md5(t), 17, 8))::bigint % 64)::int bucket, count(*)::double n from {a} group by 1, 2))"""
_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::int & 3) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_POINTS = f"p as (select {_UUID.format(h='chunk_id')} point_id, min(file_path) file_path, count(*) places from code_chunks group by 1)"
_PATHS = "p as (select distinct file_path from code_chunks where file_path is not null)"
_LINES = "t as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null)"
_PACK = (
    _LINES
    + """, k as (select doc_id, 1 i, 1 f, length(ls[1]) + 1 used, ls, [[]::int[]][2:] done from t
 union all select doc_id, i + 1, case when used + length(ls[i + 1]) + 1 > 256 then i + 1 else f end, case when used + length(ls[i + 1]) + 1 > 256 then length(ls[i + 1]) + 1 else used + length(ls[i + 1]) + 1 end, ls,
 case when used + length(ls[i + 1]) + 1 > 256 then list_append(done, [f, i]) else done end from k where i < len(ls)),
u as (select doc_id, unnest(list_append(done, [f, i])) p, ls from k where i = len(ls))"""
)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of each query that SQL can express."""
    exts = ", ".join(f"('{k}', '{v}')" for k, v in S.LANGUAGE_BY_EXTENSION.items())
    ext = r"lower(regexp_extract(file_path, '\.([^./]+)$', 1))"
    latest = "(select *, row_number() over (partition by model, content_hash order by ts desc, loaded_at desc) rn from cache_entries qualify rn = 1)"
    normal = "(select query_hash query_id, point_id corpus_id, coalesce(score, 1) rel, row_number() over (partition by query_hash, point_id order by searched_at desc, search_id desc, hit_rank desc, coalesce(score, 1) desc) rn from search_results qualify rn = 1)"
    return {
        "p3_found": _DIFF + " select * from d",
        "snapshot_diff_counts": _DIFF + " select repo, root_dir, status, count(*) files from d group by all",
        "merkle_build": _tree_sql() + " select repo, root_dir, path, hash, is_file, n_children::bigint n_children from nodes",
        "merkle_root": _tree_sql() + " select repo, root_dir, hash root_hash from nodes where path = '.'",
        "parent_path_rollup": f"with {_PATHS} select case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '.' end parent, count(*) files, min(file_path) first_file from p group by 1",
        "knn_topk_bruteforce": _RANKED.format(k=100) + " select query_id, corpus_id, round(score, 6) score, rank from r",
        "knn_blocked_matmul": _RANKED.format(k=100) + " select query_id, corpus_id, round(score, 6) score, rank from r",
        "knn_single_query_topk": "with v as (select vec_id id, embedding::double[] v, list_concat(list_concat(list_transform(range(16), lambda x: 1.0::double), list_transform(range(32), lambda x: 0.0::double)), list_transform(range(16), lambda x: -1.0::double)) q from embeddings) select id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) score from v order by list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) desc, id limit 10",
        "ir_mrr": _metrics_sql("m"),
        "ir_ndcg": _metrics_sql("n"),
        "ir_recall": _metrics_sql("r"),
        "ir_all_metrics": _metrics_sql("mnr"),
        "ir_graded_metrics": _metrics_sql("mnr", "case when a.label = b.label then 2 else 1 end", "(a.label = b.label or b.label = (a.label + 1) % 10)", " and a.label <> 9"),
        "ir_zero_relevant_queries": _metrics_sql("mnr", "case when a.label = 9 then 0 when a.label = b.label then 2 else 1 end", "(a.label = b.label or b.label = (a.label + 1) % 10)"),
        "qrels_normalize_last_wins": f"select query_id, corpus_id, round(rel, 6) rel from {normal}",
        "corpus_relevant_first_subset": "with c as (select doc_id corpus_id, coalesce(lower(trim(source)) = 'readme', false) is_rel, row_number() over (order by coalesce(lower(trim(source)) = 'readme', false) desc, doc_id) rn from documents) select corpus_id, is_rel from c where is_rel or rn <= 500",
        "queries_with_judged_docs": f"with c as (select distinct {_UUID.format(h='lower(content_hash)')} corpus_id from cache_entries) select distinct query_id from {normal} where corpus_id in (select corpus_id from c)",
        "file_hash": "select doc_id, sha256(text) hash from documents where text is not null",
        "point_uuid": f"select distinct chunk_id, {_UUID.format(h='chunk_id')} point_id from code_chunks",
        "extension_filter": f"with {_PATHS} select file_path from p where {ext} in ('ts', 'tsx')",
        "hidden_filter": rf"with {_PATHS} select file_path from p where not regexp_matches(file_path, '(^|/)\.')",
        "language_detect": f"with {_PATHS}, m(e, l) as (values {exts}) select file_path, {ext} ext, l as language from p left join m on e = {ext}",
        "relative_path": f"with {_PATHS} select file_path, case when starts_with(file_path, 'src/') then substr(file_path, 5) end below_src from p",
        "token_estimate": "select doc_id, ceil((length(text) + 1) / 4)::bigint tokens from documents where text is not null",
        "batch_token_estimate": "select doc_id, ceil(length(text) / 3)::bigint tokens from documents where text is not null",
        "truncate_text": "select doc_id, substr(text, 1, 200) head from documents where text is not null",
        "line_split_chunks": f"with recursive {_PACK} select doc_id, p[1] start_line, p[2] end_line from u",
        "chunk_content_hash": f"with recursive {_PACK} select doc_id, p[1] start_line, sha256(array_to_string(ls[p[1]:p[2]], chr(10))) hash from u",
        "merge_small_segments": "with recursive t as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: ceil((length(x) + 1) / 4)::bigint) z from documents where text is not null), k as (select doc_id, 1 i, 1 f, z[1] s, z, [[]::bigint[]][2:] done from t union all select doc_id, i + 1, case when s < 64 or z[i + 1] < 64 then f else i + 1 end, case when s < 64 or z[i + 1] < 64 then s + z[i + 1] else z[i + 1] end, z, case when s < 64 or z[i + 1] < 64 then done else list_append(done, [f, i, s]) end from k where i < len(z)), u as (select doc_id, unnest(list_append(done, [f, i, s])) p from k where i = len(z)) select doc_id, p[1]::int start_line, p[2]::int end_line, p[3] size from u",
        "token_budget_batches": "with recursive d as (select floor(doc_id / 256)::bigint run, doc_id, ceil(length(text) / 3)::bigint tokens, row_number() over (partition by floor(doc_id / 256) order by doc_id) i from documents where text is not null), k as (select run, doc_id, tokens, i, 0 batch_no, tokens used, 1 n from d where i = 1 union all select d.run, d.doc_id, d.tokens, d.i, case when used + d.tokens > 2000 or n >= 24 then batch_no + 1 else batch_no end, case when used + d.tokens > 2000 or n >= 24 then d.tokens else used + d.tokens end, case when used + d.tokens > 2000 or n >= 24 then 1 else n + 1 end from k join d on d.run = k.run and d.i = k.i + 1) select run, doc_id, tokens, batch_no from k",
        "hash_embed": "with " + _HASHED.format(a="a", b="b", key="doc_id", table="documents") + " select id doc_id, bucket, round(w, 6) weight from b",
        "semantic_search_documents": "with " + _HASHED.format(a="a", b="b", key="doc_id", table="documents") + ", " + _HASHED.format(a="x", b="y", key="item_id", table="eval_items") + ", e as (select q.item_id query_id, d.doc_id corpus_id from (select item_id from eval_items where text is not null) q cross join (select doc_id from documents where text is not null) d), s as (select e.query_id, e.corpus_id, round(coalesce(m.score, 0), 6) score from e left join (select y.id query_id, b.id corpus_id, sum(y.w * b.w) score from y join b using (bucket) group by 1, 2) m using (query_id, corpus_id)) select *, row_number() over (partition by query_id order by score desc, corpus_id)::int as rank from s qualify rank <= 5",
        "cache_probe_hit_miss": f"with c as (select distinct row_id, lower(content_hash) content_hash from code_chunks where content_hash is not null), e as (select model, content_hash, vector from {latest}), m as (select distinct model from cache_entries where model is not null) select m.model, count(*) chunks, count(e.vector) hits, count(distinct case when e.vector is null then c.content_hash end) to_embed from m cross join c left join e on e.model = m.model and e.content_hash = c.content_hash group by 1",
        "cache_prune_ttl": f"with e as (select * from {latest}) select model, content_hash from e where epoch_ms((select max(ts) from e)) - epoch_ms(ts) <= 90::bigint * 86400000",
        "cache_latest_entry": f"select model, content_hash, ts, coalesce(len(vector), -1)::bigint dims from {latest}",
        "cache_stats": f"select count(*) entries, sum(coalesce(len(vector), 0) * 4)::bigint size_bytes from {latest}",
        "upsert_last_wins": f"with r as (select {_UUID.format(h='chunk_id')} point_id, file_path, start_line, row_number() over (partition by chunk_id order by loaded_at desc, row_id desc) rn from code_chunks), n as (select point_id, payload.file_path file_path, payload.start_line start_line, row_number() over (partition by point_id order by searched_at desc, search_id desc, hit_rank desc, payload.file_path desc, payload.start_line desc) rn from search_results where payload is not null and point_id is not null) select point_id, file_path, start_line from n where rn = 1 union all select point_id, file_path, start_line from r where rn = 1 and point_id not in (select point_id from n)",
        "delete_by_paths": f"with {_POINTS} select * from p where not starts_with(file_path, 'tests/')",
        "delete_by_ids": f"with {_POINTS} select * from p where point_id not in (select point_id from search_results where point_id is not null)",
        "scroll_points": f"with {_POINTS} select * from p order by point_id limit 100",
        "collection_info": "select count(distinct chunk_id) points, 'green' status from code_chunks",
        "jsonl_round_trip": "select doc_id, text, lang from documents",
        "matrix_round_trip": "select embedding[1]::double as first, embedding[64]::double as last, len(embedding)::bigint dims from embeddings",
        "incremental_index_run": r"with f as (select distinct concat_ws('/', repo, root_dir, file_path) path from code_chunks where regexp_matches(lower(file_path), '\.tsx?$')), p as (select ('0x' || substr(md5(path), 1, 4))::int % 3 part from f), c as (select count(*) n, count(*) filter (part = 0) gone, count(*) filter (part = 1) changed from p) select 'first' run, n total_files, n added, 0 modified, 0 removed, 0 failed_files from c union all select 'same', n, 0, 0, 0, 0 from c union all select 'changed', n - gone, 0, changed, gone, 0 from c union all select 'stats', n - gone, 0, 0, 0, 0 from c",
        "index_stats": "select count(distinct (repo, root_dir, file_path)) total_files, count(distinct row_id) total_chunks, count(distinct chunk_id) distinct_contents from code_chunks",
        "enrich_line_ranges": "with t as (select 'docs/' || doc_id file_path, string_split(text, chr(10)) ls from documents where text is not null) select file_path, s::int start_line, e::int end_line, coalesce(array_to_string(ls[s:e], chr(10)), '') as content from t cross join (values (1, 2), (3, 400)) v(s, e) union all select file_path || '.gone', 1, 1, '[File not found: ' || file_path || '.gone]' from t",
        "format_for_llm": _RANKED.format(k=5) + ", x as (select query_id, rank, '--- #' || rank || ' vectors/' || label || ':1-' || label || ' (score: ' || printf('%.3f', round(score, 2)) || ') ' || case when label % 2 = 0 then '[s' || label || '] ' else '' end || '---' || chr(10) || 'id ' || corpus_id t from r join embeddings on vec_id = corpus_id) select query_id, string_agg(t, chr(10) || chr(10) order by rank) as text from x group by 1",
        "format_bytes": "select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0) else printf('%.1f MB', n / 1048576.0) end size from (select doc_id, (n_chars * 997)::bigint n from documents)",
        "result_bar_format": _RANKED.format(k=5) + " select query_id, rank, repeat('█', round(greatest(round(score, 2), 0) * 20)::int) || repeat('░', 20 - round(greatest(round(score, 2), 0) * 20)::int) bar from r",
        "path_safe_names": "select distinct repo, regexp_replace(repo || ':' || root_dir, '[/" + r"\\" + ":]', '_', 'g') safe from code_chunks",
    }
