"""Scanning, indexing, searching and evaluating end to end on small trees."""

import json

import pytest

from sparkseek.config import IndexConfig, split_extensions
from sparkseek.plans.evaluation import evaluate
from sparkseek.plans.pipeline import Indexer
from sparkseek.sources.dataset import load, read_rows, registry
from sparkseek.sources.scan import list_files, scan


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "_u.ts": "export const u = 1;", "b.TS": "export const b = 2;", ".h.ts": "x", "_d/d.ts": "export function dd() { return 'vector search'; }", "sub/c.ts": "export function cc() { return 'merkle tree hash'; }", "node_modules/x.ts": "x",
        "sub/skip.ts": "x", "sub/keep/skip.ts": "k", "out/o.ts": "x", "noext": "x", "cur.ts": "x", ".gitignore": "/out/\nsub/skip.ts\n# c\n", ".cursorignore": "cur.ts\n", "sub/keep/.gitignore": "!skip.ts\n*.log\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_listing(tree):
    assert list_files(str(tree), (".ts",)) == ["_d/d.ts", "_u.ts", "b.TS", "sub/c.ts", "sub/keep/skip.ts"]
    with pytest.raises(NotADirectoryError):
        list_files(str(tree / "noext"))
    assert split_extensions(" .ts, TSX,,") == (".ts", ".tsx")


def test_scan_replaces_broken_bytes(spark, tree):
    (tree / "bad.ts").write_bytes(b"a\xff\nb")
    rows = {r["path"]: r["text"] for r in scan(spark, str(tree), (".ts",)).collect()}
    assert rows["bad.ts"] == "a�\nb" and len(rows) == 6


def test_index_lifecycle(spark, tree, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    indexer = Indexer(spark, IndexConfig(root_dir=str(tree), index_dir=folder, extensions=(".ts",), min_chunk_tokens=1))
    first = indexer.index()
    assert first["added"] == 5 and first["new_chunks"] == first["total_chunks"] > 0
    again = indexer.index()
    assert again["total_chunks"] == 0 and again["added"] == again["modified"] == again["removed"] == 0
    (tree / "copy.ts").write_text((tree / "sub/c.ts").read_text())
    (tree / "_u.ts").write_text("export const u = 11;")
    (tree / "b.TS").unlink()
    third = indexer.index()
    assert (third["added"], third["modified"], third["removed"]) == (1, 1, 1) and third["cached_chunks"] == 1
    (tree / "copy.ts").unlink()
    indexer.index()
    queries = spark.createDataFrame([("q", "export function cc() { return 'merkle tree hash'; }")], "query_id string, text string")
    best = indexer.search_enriched(queries, scan(spark, str(tree), (".ts",)), 1).collect()
    assert [(r["file_path"], r["rank"]) for r in best] == [("sub/c.ts", 1)] and "merkle" in best[0]["content"] and best[0]["score"] == pytest.approx(1, abs=1e-6)
    assert indexer.stats()["status"] == "green" and indexer.stats_frame().first()["points"] == indexer.stats()["points"]
    with pytest.raises(ValueError):
        Indexer(spark, IndexConfig(index_dir=folder, dim=8)).store.ensure()
    indexer.reset()
    assert indexer.store.info() == {"points": 0, "status": "not_found"}


def test_a_file_that_fails_is_tried_again(spark, tmp_path):
    from sparkseek.chunk.files import chunk_file

    rows = [("a.ts", "export const a = 1;"), ("bad.ts", "FAIL"), ("c.ts", "export const c = 1;")]
    files = spark.createDataFrame([(p, str(hash(t)), t) for p, t in rows], "path string, hash string, text string")
    indexer = Indexer(spark, IndexConfig(index_dir=str(tmp_path / "index"), min_chunk_tokens=1))
    told = []

    def fails(path, text, most=512, least=64):
        if text == "FAIL":
            raise RuntimeError("unreadable")
        return chunk_file(path, text, most, least)

    indexer.reader = fails
    first = indexer.index(files, lambda stage, counts: told.append((stage, counts["failed_files"])))
    assert (first["added"], first["failed_files"], first["total_chunks"]) == (3, 1, 2) and told == [("compare", 0), ("embed", 1), ("done", 1)]
    assert {r["path"] for r in indexer.store.table("leaves").collect()} == {"a.ts", "c.ts"} and "bad.ts" not in {r["path"] for r in indexer.store.table("nodes").collect()}
    indexer.reader = chunk_file
    again = indexer.index(files)
    assert (again["added"], again["failed_files"], again["total_chunks"]) == (1, 0, 1)
    assert {r["file_path"] for r in indexer.store.table("places").collect()} == {"a.ts", "bad.ts", "c.ts"}


def test_store_writes_only_what_changes(spark, tmp_path):
    from sparkseek.operators.store import VectorStore

    store = VectorStore(spark, str(tmp_path / "s"), 2, "m")
    store.ensure()
    entry = lambda h, t: spark.createDataFrame([("m", h, [1.0, 2.0], t)], "model string, content_hash string, vector array<float>, t long").selectExpr("model", "content_hash", "vector", "timestamp_seconds(t) ts")
    store.commit(cache=entry("a", 0), leaves=spark.createDataFrame([("p", "h")], "path string, hash string"))
    before = store.manifest()["parts"]
    store.commit({"cache": entry("b", 1000)})
    after = store.manifest()["parts"]
    assert after["leaves"] == before["leaves"] and after["cache"][0] == before["cache"][0] and len(after["cache"]) == 2 and store.table("cache").count() == 2
    from pyspark.sql import functions as F

    assert store.prune_cache(F.timestamp_seconds(F.lit(1000)), 999_999) == 1 and [r["content_hash"] for r in store.table("cache").collect()] == ["b"]
    store.clear("cache")
    assert store.table("cache").count() == 0 and store.table("leaves").count() == 1


def test_providers(spark, tmp_path):
    from sparkseek.embed.hashing import HashingProvider
    from sparkseek.embed.providers import RemoteProvider, budget_batches, choose_provider

    def transport(texts):
        if len(texts) > 3 or any(len(t) > 30 for t in texts):
            raise ValueError("too much")
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(40)], "id int, content string").repartition(2)
    remote = RemoteProvider(transport, "m", 2, max_chars=30, budget=12, most=3)
    assert {r["id"]: r["vector"][0] for r in remote.embed(rows).collect()} == {i: float(min(i, 30)) for i in range(40)}
    assert choose_provider(remote, lambda: HashingProvider(8)) is remote and remote.dim == 2
    said = []
    broken = RemoteProvider(lambda texts: 1 / 0, "m", 2)
    assert choose_provider(broken, lambda: HashingProvider(8), said.append).model == "hash-8" and len(said) == 1 and choose_provider(None, lambda: HashingProvider(8)).dim == 8
    assert list(budget_batches(["a" * 30, "b" * 6, "c" * 100, "d"], 12, 2)) == [(0, 2), (2, 3), (3, 4)] and list(budget_batches([])) == []


def test_dataset_parts(spark, tmp_path):
    from sparkseek.sources.dataset import dataset_info, is_cached, read_rows

    frame = spark.createDataFrame([("q", "c", 1.0, "test"), ("r", "c", 1.0, "train")], "query_id string, corpus_id string, score double, split string").coalesce(1)
    frame.write.parquet(str(tmp_path / "by_column"))
    frame.limit(1).write.parquet(str(tmp_path / "by_folder/test"))
    assert read_rows(spark, str(tmp_path / "by_column"), "qrels", "test").count() == 1 and read_rows(spark, str(tmp_path / "by_column")).count() == 2
    assert read_rows(spark, str(tmp_path / "by_folder"), "qrels", "test").count() == 1
    assert not is_cached(spark, str(tmp_path))
    for name in ("corpus", "queries", "qrels"):
        (tmp_path / f"{name}.jsonl").write_text('{"_id": 1, "text": "x"}\n')
    assert is_cached(spark, str(tmp_path)) and dataset_info("cosqa") == ("test", "python") and dataset_info("other") is None


def test_ignore_file_of_the_user(tree, tmp_path_factory, monkeypatch):
    home = tmp_path_factory.mktemp("home")
    (home / "git").mkdir()
    (home / "git/ignore").write_text("c.ts\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(home))
    monkeypatch.setenv("HOME", str(home))
    assert list_files(str(tree), (".ts",)) == ["_d/d.ts", "_u.ts", "b.TS", "sub/keep/skip.ts"]


def test_settings_from_environment(tmp_path, monkeypatch):
    (tmp_path / "x.env").write_text("# c\nexport SPARKSEEK_COLLECTION='from file'\nSPARKSEEK_TOP_K=3 # few\nSPARKSEEK_EXTENSIONS=.js, TS\nnothing\n")
    monkeypatch.setenv("SPARKSEEK_TOP_K", "4")
    config = IndexConfig.from_environment(str(tmp_path / "x.env"), model="given", index_dir=None)
    assert (config.collection, config.top_k, config.extensions, config.model, config.index_dir) == ("from file", 4, (".js", ".ts"), "given", IndexConfig().index_dir)
    assert IndexConfig.from_environment(None).top_k == 4


def test_nothing_found(spark):
    from sparkseek.operators.enrich import formatted

    hits = spark.createDataFrame([("q", 1, "a.ts", 1, 2, 0.5, None, "x")], "query_id string, rank int, file_path string, start_line int, end_line int, score double, symbol_name string, content string")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert {r["query_id"]: r["text"].split("\n")[-1] for r in formatted(hits, ["query_id"], asked).collect()} == {"q": "x", "none": "No relevant code found."}


def test_stream_of_files(spark, tmp_path):
    from sparkseek.streaming.ingest import index_stream

    source = tmp_path / "in"
    source.mkdir()
    indexer = Indexer(spark, IndexConfig(index_dir=str(tmp_path / "index"), min_chunk_tokens=1))
    schema = "path string, text string"
    for n, rows in enumerate(([("a.ts", "export const a = 1;"), ("b.ts", "export const b = 1;")], [("a.ts", None), ("c.ts", "export const c = 1;")])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"path": p, "text": t}) for p, t in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        index_stream(stream, indexer, str(tmp_path / "state"), once=True).awaitTermination()
    assert {r["path"] for r in indexer.store.table("leaves").collect()} == {"b.ts", "c.ts"}
    assert {r["file_path"] for r in indexer.store.table("places").collect()} == {"b.ts", "c.ts"}


def test_evaluation(spark, tmp_path):
    parts = {
        "corpus": [{"_id": i, "text": t, "title": ""} for i, t in enumerate(["sort a list", "read a file", "hash a tree", "walk folders"])],
        "queries": [{"_id": "q1", "text": "hash tree"}, {"_id": "q2", "text": "read file"}, {"_id": "q3", "text": "unjudged"}],
        "qrels": [{"query-id": "q1", "corpus-id": "2", "score": 1}, {"query-id": "q2", "corpus-id": "1"}],
    }
    for name, rows in parts.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    data = load(*[read_rows(spark, str(tmp_path / f"{n}.jsonl")) for n in parts], max_corpus=3)
    assert data.corpus.count() == 3 and data.queries.count() == 2
    result = evaluate(data, name="small").first()
    assert result["mrr@1"] == 1.0 and (result["dataset"], result["model"], result["num_queries"], result["num_corpus"]) == ("small", "hash-256", 2, 3) and result["total_ms"] >= result["search_ms"]
    from sparkseek.embed.hashing import HashingProvider
    from sparkseek.operators.store import VectorStore

    asked = []

    class Counting(HashingProvider):
        def embed(self, rows, text="content"):
            asked.append(rows.count())
            return super().embed(rows, text)

    cache = VectorStore(spark, str(tmp_path / "cache"), 256, "hash-256")
    assert [evaluate(data, Counting(256), cache).first()["mrr@1"] for _ in range(2)] == [1.0, 1.0] and asked == [3, 2, 0, 0] and cache.table("cache").count() == 5
    assert registry(spark).count() == 7


def test_matrix_and_json_lines(spark, tmp_path):
    import numpy as np

    from sparkseek.embed.registry import dimension
    from sparkseek.sources.files import bytes_by_folder, count_lines, dataset_metadata, read_matrix, write_jsonl

    (tmp_path / "m.bin").write_bytes(np.arange(12, dtype="<f4").tobytes())
    assert [tuple(r["vector"]) for r in read_matrix(spark, str(tmp_path / "m.bin"), 4).orderBy("row").collect()] == [(0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11)]
    from sparkseek.sources.files import write_matrix

    rows = spark.createDataFrame([(i, [float(i), -1.0]) for i in range(50)], "row int, vector array<double>").repartition(3)
    write_matrix(rows, str(tmp_path / "matrix"))
    back = [r["vector"][0] for r in read_matrix(spark, str(tmp_path / "matrix"), 2).orderBy("file", "row").collect()]
    assert back == [float(i) for i in range(50)]
    write_jsonl(spark.createDataFrame([(1, "ä"), (2, None)], "a int, b string").coalesce(1), str(tmp_path / "out"))
    assert count_lines(spark, str(tmp_path / "out")) == 2
    one = spark.range(1)
    assert dataset_metadata(one, one, one, "d").first()["corpus"] == 1
    with pytest.raises(ValueError):
        dataset_metadata(one, one.limit(0), one, "d")
    assert sum(r["size_bytes"] for r in bytes_by_folder(spark, str(tmp_path)).collect()) >= 48
    assert dimension("hash-8") == 8 and dimension("BAAI/bge-m3") == 1024
    with pytest.raises(ValueError):
        dimension("other")
