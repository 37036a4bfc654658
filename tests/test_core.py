"""Core operators against small models of their rules."""

import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.chunk.files import chunk_file
from sparkseek.chunk.segments import FileSegments
from sparkseek.functions import scalars as S
from sparkseek.operators import cache, enrich, folds, knn, merkle, ranking, snapshots, store

NODES = "repo string, root_dir string, snapshot_no int, path string, hash string, is_file boolean, loaded_at long, extra int"


def changes_by_hand(rows):
    held = {}
    for repo, root, no, path, h, is_file, at, _ in sorted((r for r in rows if None not in r[:4]), key=lambda r: (r[6] is not None, r[6] or 0, (r[4] or "").lower(), r[5] or False)):
        held[repo, root, no, path] = ((h or "").lower(), is_file)
    numbers = defaultdict(set)
    for repo, root, no, *_ in [r for r in rows if None not in r[:3]]:
        numbers[repo, root].add(no)
    out = set()
    for (repo, root), have in numbers.items():
        order = sorted(have)
        for old, new in zip(order, order[1:]):
            a = {p: h for (r, d, n, p), (h, f) in held.items() if (r, d, n) == (repo, root, old) and f}
            b = {p: h for (r, d, n, p), (h, f) in held.items() if (r, d, n) == (repo, root, new) and f}
            for p in a.keys() | b.keys():
                if p not in a:
                    out.add((repo, root, new, p, "added"))
                elif p not in b:
                    out.add((repo, root, new, p, "removed"))
                elif a[p] != b[p]:
                    out.add((repo, root, new, p, "modified"))
    return out


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for repo in ("a", "b"):
        for no in (1, 2, 5, 6):
            for p in rng.sample(range(40), 30):
                rows.append((repo, "r", no, f"d/f{p}.ts", rng.choice(["aa", "bb", None]), rng.random() > 0.1, rng.randrange(5), 1))
            rows.append((repo, "r", no, ".", "root", False, 0, 1))
    rows += [("a", "r", 7, ".", "x", False, 1, 1), ("a", None, 1, "p", "h", True, 1, 1), ("a", "r", 2, None, "h", True, 1, 1)]
    rows += rows[:10]
    got = {tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, NODES), leaf_bits=6, fan_bits=3).collect()}
    assert got == changes_by_hand(rows)
    assert any(r[4] == "removed" and r[2] == 7 for r in got)  # a snapshot that holds only its root


def test_snapshot_changes_spelling_and_empty(spark):
    rows = [("a", "r", 1, "./x\\y.ts", "AB", True, 1, 0), ("a", "r", 2, "x/y.ts", "ab", True, 1, 0), ("a", "r", 2, "X/y.ts", "ab", True, 1, 0)]
    got = [tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, NODES)).collect()]
    assert got == [("a", "r", 2, "X/y.ts", "added")]
    assert snapshots.snapshot_changes(spark.createDataFrame([], NODES)).collect() == []


def test_merkle_tree_and_root(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = [("a.ts", "1"), ("src/b.ts", "2"), ("src/x/c.ts", "3"), ("lib/d.ts", "4"), (None, "5")]
    nodes = {r["path"]: r for r in merkle.merkle_tree(spark.createDataFrame(leaves, "path string, hash string")).collect()}
    x, lib = sha("3"), sha("4")
    src = sha("".join(sorted(["2", x])))
    assert nodes["src"]["hash"] == src and nodes["src"]["children"] == ["src/b.ts", "src/x"]
    assert nodes["."]["hash"] == sha("".join(sorted(["1", src, lib])))
    tree = spark.createDataFrame([tuple(r) for r in nodes.values()], "path string, hash string, is_file boolean, children array<string>")
    assert merkle.root_hash(tree).first()["root_hash"] == nodes["."]["hash"]
    assert merkle.merkle_tree(spark.createDataFrame([], "path string, hash string")).count() == 0


def test_leaf_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, hash string")
    assert {tuple(r) for r in merkle.leaf_changes(old, new).collect()} == {("a", "removed"), ("c", "modified"), ("d", "added")}


def test_scalars(spark):
    digest = "a" * 16 + "0" + "b" * 47
    row = spark.range(1).select(
        S.sha256_uuid(F.lit(digest)).alias("u"), S.parent_path(F.lit("a/b/c.ts")).alias("p"), S.parent_path(F.lit("c.ts")).alias("p0"), S.file_extension(F.lit("x/Y.TsX")).alias("e"), S.language(F.lit("q.rs")).alias("l"),
        S.is_hidden(F.lit("a/.b/c")).alias("h"), S.relative_path(F.lit("/r/x"), "/r/").alias("rel"), S.relative_path(F.lit("/q/x"), "/r").alias("rel0"), S.line_range(F.lit("a\nb\nc"), F.lit(0), F.lit(2)).alias("lr"),
        S.line_range(F.lit("a\nb"), F.lit(9), F.lit(12)).alias("lr0"), S.line_tokens(F.lit("1234")).alias("lt"), S.batch_tokens(F.lit("1234")).alias("bt"), S.byte_size(F.lit(2048)).alias("bs"), S.percent_bar(F.lit(0.25)).alias("bar"),
    ).first()
    assert row["u"] == "aaaaaaaa-aaaa-5aaa-8bbb-bbbbbbbbbbbb"
    assert (row["p"], row["p0"], row["e"], row["l"], row["h"], row["rel"], row["rel0"]) == ("a/b", ".", "tsx", "rust", True, "x", None)
    assert (row["lr"], row["lr0"], row["lt"], row["bt"], row["bs"]) == ("a\nb", "", 2, 2, "2.0 KB")
    assert row["bar"] == "█" * 5 + "░" * 15


def pack(lines, room):
    out, first, used = [], 0, 0
    for i, line in enumerate(lines):
        if used + len(line) + 1 > room and i > first:
            out.append((first + 1, i))
            first, used = i, 0
        used += len(line) + 1
    return [*out, (first + 1, len(lines))] if lines else []


def merge(sizes, least):
    out = []
    for i, s in enumerate(sizes, 1):
        if out and (out[-1][2] < least or s < least):
            out[-1] = (out[-1][0], i, out[-1][2] + s)
        else:
            out.append((i, i, s))
    return out


def test_folds_against_models(spark):
    rng = random.Random(1)
    rows = [(i, ["x" * rng.randrange(60) for _ in range(rng.randrange(0, 40))], [rng.randrange(100) for _ in range(rng.randrange(0, 30))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, lines array<string>, sizes array<long>").select("id", folds.pack_lines(F.col("lines"), 100).alias("p"), folds.merge_small(F.col("sizes"), 64).alias("m"))
    for r, (_, lines, sizes) in zip(df.orderBy("id").collect(), rows):
        assert [tuple(x) for x in r["p"]] == pack(lines, 100)
        assert [tuple(x) for x in r["m"]] == merge(sizes, 64)


def test_token_batches(spark):
    sizes = [5999, 1, 1, 9000, 10, 10] + [0] * 5
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)], "g int, i long, s long")
    got = [r["batch_no"] for r in folds.token_batches(rows, ["g"], "i", "s", 6000, 4).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 3, 4, 4, 4]


def test_top_k_forms_agree(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(80)] + [(80, None)]
    corpus = spark.createDataFrame(rows, "corpus_id long, vector array<double>")
    queries = corpus.filter("corpus_id < 5").withColumnRenamed("corpus_id", "query_id")
    a = {tuple(r) for r in knn.top_k(queries, corpus, 7).select("query_id", "corpus_id", "rank").collect()}
    b = {tuple(r) for r in knn.top_k_blocked(queries, corpus, 7, block=2).select("query_id", "corpus_id", "rank").collect()}
    assert a == b and len(a) == 35


def test_blocks_of_many_queries_with_ids_of_any_type(spark):
    rng = random.Random(5)
    rows = [(f"v{i:04}", [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(900)] + [("null", None), (None, [1.0] * 4)]
    table = spark.createDataFrame(rows, "id string, vector array<double>")
    queries, corpus = table.withColumnRenamed("id", "query_id"), table.withColumnRenamed("id", "corpus_id")
    for same in (True, False):
        want = {(r["query_id"], r["corpus_id"], r["score"], r["rank"]) for r in knn.top_k(queries, corpus, 7, same).collect()}
        assert len(want) == 900 * 7
        for block, size in ((4096, 65_536), (100, 300)):
            assert {(r["query_id"], r["corpus_id"], r["score"], r["rank"]) for r in knn.top_k_blocked(queries, corpus, 7, same, block, size).collect()} == want
    assert knn.top_k_blocked(queries.limit(0), corpus, 3).collect() == [] == knn.top_k_blocked(queries, corpus.limit(0), 3).collect()
    with pytest.raises(ValueError):
        knn.top_k(spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vector")), corpus, 3)


def test_judgements_as_maps(spark):
    rows = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0), ("r", "a", 2.0), (None, "a", 1.0)], "query_id string, corpus_id string, rel double")
    assert {r["query_id"]: r["rels"] for r in ranking.qrels_by_query(rows).collect()} == {"q": {"a": 1.0, "b": 0.0}, "r": {"a": 2.0}}


def test_names_for_sql(spark):
    from sparkseek.chunk.files import register_chunk_table

    S.register(spark)
    register_chunk_table(spark)
    row = spark.sql("select sha256_uuid(sha2('a', 256)) u, est_tokens('abcd') t, cosine_similarity(array(1D, 0D), array(1D, 1D)) c").first()
    assert row["t"] == 2 and row["c"] == pytest.approx(0.5**0.5) and row["u"] == spark.range(1).select(S.sha256_uuid(F.sha2(F.lit("a"), 256)).alias("u")).first()["u"]
    assert [r["symbol_name"] for r in spark.sql("select * from chunk_file('a.ts', 'export function f() { return 1; }')").collect()] == ["f"]
    assert spark.range(1).select(S.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("v")).first()["v"] == pytest.approx([0.6, 0.8])
    assert spark.range(1).select(S.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first()["v"] == [0.0, 0.0]


def test_spread_runs_no_job(spark):
    from sparkseek.operators.codefiles import spread

    context = spark.sparkContext
    context.setJobGroup("spread", "")
    spread(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    spread(spark.range(100, numPartitions=64).filter("id > 3"))
    assert list(context.statusTracker().getJobIdsForGroup("spread")) == []
    context.setLocalProperty("spark.jobGroup.id", None)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from sparkseek.session import checkpoint_dir

    empty = N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True)))
    with pytest.raises(ValueError):
        checkpoint_dir(N(conf=N(get=lambda *a: None), sparkContext=N(master="spark://x:7077", _jsc=empty)))


def test_nearest(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, vector array<double>")
    assert [r["id"] for r in knn.nearest(points, [2.0, 0.0], 3).collect()] == ["a", "b", "c"]


def model_metrics(ranked, qrels):
    judged = defaultdict(dict)
    for q, c, r in qrels:
        judged[q][c] = max(judged[q].get(c, 0), 1.0 if r is None else r)
    order = defaultdict(dict)
    for q, c, k in ranked:
        order[q][k] = c
    out = {}
    qs = [q for q in order if q in judged]
    for k in (1, 5, 10):
        rr, nd = [], []
        for q in qs:
            rels = [judged[q].get(order[q].get(i), 0) for i in range(1, k + 1)]
            rr.append(next((1 / i for i, r in enumerate(rels, 1) if r > 0), 0))
            dcg = sum((2**r - 1) / math.log2(i + 1) for i, r in enumerate(rels, 1))
            best = sorted(judged[q].values(), reverse=True)[:k]
            ideal = sum((2**r - 1) / math.log2(i + 1) for i, r in enumerate(best, 1))
            nd.append(dcg / ideal if ideal else 0)
        out[f"mrr@{k}"], out[f"ndcg@{k}"] = sum(rr) / len(qs), sum(nd) / len(qs)
    for k in (1, 5, 10, 100):
        rs = [sum(judged[q].get(order[q].get(i), 0) > 0 for i in range(1, k + 1)) / n for q in qs if (n := sum(r > 0 for r in judged[q].values()))]
        out[f"recall@{k}"] = sum(rs) / len(rs) if rs else 0
    return out


def test_metrics_against_model(spark):
    rng = random.Random(4)
    ranked = [(q, c, k) for q in range(12) for k, c in enumerate(rng.sample(range(40), 20), 1)]
    qrels = [(q, c, rng.choice([0.0, 0.0, 1.0, 2.0])) for q in range(10) for c in rng.sample(range(40), 6)] + [(10, 3, 0.0), (10, 4, 0.0)]
    got = ranking.metrics(spark.createDataFrame(ranked, "query_id long, corpus_id long, rank int"), spark.createDataFrame(qrels, "query_id long, corpus_id long, rel double")).first().asDict()
    want = model_metrics(ranked, qrels)
    assert got == pytest.approx(want, abs=1e-6)
    assert got["mrr@1"] <= got["mrr@5"] <= got["mrr@10"] and got["recall@1"] <= got["recall@100"]
    empty = ranking.metrics(spark.createDataFrame([], "query_id long, corpus_id long, rank int"), spark.createDataFrame([], "query_id long, corpus_id long, rel double")).first()
    assert set(empty) == {0.0}


def test_qrels_and_subsets(spark):
    rows = spark.createDataFrame([("1", "a", 2.0, 1), ("1", "a", None, 2), (None, "b", 0.0, 3)], "`query-id` string, `corpus-id` string, score double, pos int")
    assert {tuple(r) for r in ranking.normalized_qrels(rows, ["pos"]).collect()} == {("1", "a", 1.0), ("", "b", 0.0)}
    corpus = spark.createDataFrame([(str(i), i) for i in range(10)], "corpus_id string, pos int")
    relevant = spark.createDataFrame([("7",), ("9",), ("7",), ("nowhere",)], "corpus_id string")
    assert {r["corpus_id"] for r in ranking.relevant_first(corpus, relevant, 4).collect()} == {"7", "9", "0", "1"}
    assert ranking.relevant_first(corpus, relevant, 1).count() == 2 and ranking.relevant_first(corpus, relevant, None).count() == 10


def test_cache(spark):
    rows = [("m", "h", [1.0], 10, 1), ("m", "h", [2.0], 20, 1), ("m", "g", None, 5, 1), (None, "g", [1.0], 5, 1)]
    entries = spark.createDataFrame(rows, "model string, content_hash string, vector array<double>, ms long, extra int").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    got = {r["content_hash"]: r["vector"] for r in cache.latest_entries(entries).collect()}
    assert got == {"h": [2.0], "g": None}
    kept = cache.pruned(entries, F.timestamp_millis(F.lit(30)), 20)
    assert kept.count() == 2  # exactly the age limit stays
    probed = {r["content_hash"]: r["vector"] for r in cache.probe(spark.createDataFrame([("H",), ("x",), (None,)], "content_hash string"), entries, "m").collect()}
    assert probed == {"H": [2.0], "x": None, None: None}


def test_store_rows(spark):
    have = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, o int")
    assert {tuple(r) for r in store.upserted(have, new, "k", "o").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert store.without(have, have.limit(0), "k").count() == 2
    assert [r["k"] for r in store.without(have, new.select("k"), "k").collect()] == ["a"]


def test_enrich_and_format(spark):
    hits = spark.createDataFrame([(1, "a", 2, 3, 0.5, "f"), (2, "b", 1, 1, 0.25, None)], "rank int, file_path string, start_line int, end_line int, score double, symbol_name string")
    files = spark.createDataFrame([("a", "x\ny\nz")], "file_path string, text string")
    rows = enrich.with_lines(hits, files)
    assert {r["file_path"]: r["content"] for r in rows.collect()} == {"a": "y\nz", "b": "[File not found: b]"}
    text = enrich.formatted(rows.withColumn("q", F.lit(1)), ["q"]).first()["text"]
    assert text == "--- #1 a:2-3 (score: 0.500) [f] ---\ny\nz\n\n--- #2 b:1-1 (score: 0.250) ---\n[File not found: b]"


# chunker
def kinds(text, path="a.ts", most=512, least=0):
    return [(r[2], r[3], r[6], r[7]) for r in chunk_file(path, text, most, least)]


def test_comments_belong_to_the_next_statement():
    assert kinds("// one\n// two\nfunction f() {}\n\n// gone\nif (x) {}\nconst a = 1;\n// last") == [(1, 3, "function_declaration", "f"), (7, 7, "lexical_declaration", None)]
    assert kinds("") == [] and kinds("// only\n/* comments */") == [] and kinds("if (a) { b(); }") == []


def test_statement_types():
    source = "import a from 'a';\nexport const b = 1;\nexport default class C {}\nabstract class D {}\ninterface E {}\ntype F = 1;\nenum G { A }\nvar h;\nk();\nfunction* m() {}\ndeclare const n: 1;\n"
    assert [(k, s) for _, _, k, s in kinds(source)] == [
        ("import_statement", None), ("export_statement", None), ("export_statement", "C"), ("abstract_class_declaration", "D"), ("interface_declaration", "E"), ("type_alias_declaration", "F"), ("enum_declaration", "G"), ("variable_declaration", None), ("expression_statement", None), ("generator_function_declaration", "m"),
    ]


def test_big_class_is_split_by_members():
    body = "\n".join(f"    this.call{i}('some longer argument', {i});" for i in range(20))
    source = f"class A {{\n  private x = 1;\n  // about m\n  m() {{\n{body}\n  }}\n  n() {{ return 1; }}\n}}"
    got = kinds(source, most=200, least=10)
    assert got[0][2].startswith(("public_field_definition", "method_definition")) and {s.split(" ")[0] for *_, s in got} <= {"A.x", "A.m", "A.n", "A"}
    assert any(k == "method_definition_part" for _, _, k, _ in got)
    lines = [n for a, b, *_ in got for n in range(a, b + 1)]
    assert lines == list(range(1, len(source.split("\n")) + 1))


def test_big_object_and_function_blocks():
    calls = "\n".join(f"      if (a{i}) {{ run{i}('with an argument of some length'); }}" for i in range(12))
    source = f"export const api = {{\n  m() {{\n{calls}\n  }},\n  k: 2,\n  ...rest,\n}};"
    got = kinds(source, most=100, least=1)
    assert {k for _, _, k, _ in got} >= {"method_definition_block", "pair"} and any(s == "api.m" for *_, s in got)
    blocks = FileSegments("a.ts", f"function f() {{\n  return () => {{\n{calls}\n  }};\n}}").segments()[0].blocks
    assert len(blocks) == 12 and {b.kind for b in blocks} == {"if_statement"}


def test_small_neighbours_are_joined():
    got = kinds("const a = 1;\nconst b = 2;\nfunction longer() {\n  return a + b + 1000;\n}\n", least=64)
    assert got == [(1, 5, "function_declaration", "longer")]


def test_long_statement_is_split_by_lines():
    source = "const t = `\n" + "\n".join("x" * 30 for _ in range(40)) + "\n`;"
    got = kinds(source, most=64)
    assert [s for *_, s in got][:2] == ["(part 1)", "(part 2)"] and got[-1][1] == 42


def test_tsx_and_broken_text():
    assert kinds("const C = () => <div className=\"a\">What's {x}</div>;\n", "a.tsx") == [(1, 1, "lexical_declaration", None)]
    assert [k for _, _, k, _ in kinds("const a = ;\nfunction ok() {}\n")] == ["function_declaration"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["const a = 1;", "function f() { return 1; }", "class K { m() { return 2; } }", "// note", "", "if (a) {", "}", "foo('x');", "export const q = { a: 1 };"]), max_size=25), st.integers(8, 60), st.integers(0, 20))
def test_chunks_lie_in_the_file_in_order(lines, most, least):
    source = "\n".join(lines)
    rows = chunk_file("a.ts", source, most, least)
    for a, b in zip(rows, rows[1:]):
        assert a[2] <= b[2]
    for r in rows:
        assert 1 <= r[2] <= r[3] <= len(lines) and r[4] == "\n".join(source.split("\n")[r[2] - 1 : r[3]])
