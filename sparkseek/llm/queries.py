"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..operators.codefiles import FILE
from .copies import collapsed_records, equal_records
from .docpairs import documented_functions
from .leakage import leaked_items
from .mixing import classifier_report, mixed_documents, reached_shares
from .neighbours import left_out_entries, recall_report, similar_entries, similar_pairs, valid_entries
from .parsing import parse_rates, unparsable_files
from .provenance import foreign_code, recurrence_report
from .secrets import redacted_chunks, secret_places
from .sentences import document_units, unit_texts

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_chunks")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: equal_records(_chunks(s, d)),
        "p1_records": lambda s, d: collapsed_records(_chunks(s, d)),
        "p2_found": lambda s, d: similar_pairs(table(s, d, "cache_entries")),
        "p2_neighbours": lambda s, d: similar_entries(valid_entries(table(s, d, "cache_entries"))),
        "p2_recall": lambda s, d: recall_report(table(s, d, "cache_entries")),
        "p2_left_out": lambda s, d: left_out_entries(table(s, d, "cache_entries")),
        "p4_found": lambda s, d: foreign_code(_chunks(s, d)).select(*FILE),
        "p4_kinds": lambda s, d: foreign_code(_chunks(s, d)).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("files")),
        "p4_recurrence": lambda s, d: recurrence_report(_chunks(s, d)),
        "p5_found": lambda s, d: unparsable_files(_chunks(s, d)).select(*FILE),
        "p5_failures": lambda s, d: unparsable_files(_chunks(s, d)).drop("valid"),
        "p6_found": lambda s, d: documented_functions(_chunks(s, d)).select(*FILE, "symbol"),
        "p6_pairs": lambda s, d: documented_functions(_chunks(s, d), include_broken=True),
        "p7_found": lambda s, d: secret_places(_chunks(s, d)).select("row_id", "line_no").distinct(),
        "p7_kinds": lambda s, d: secret_places(_chunks(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("row_id").alias("records")),
        "p7_redacted": lambda s, d: redacted_chunks(_chunks(s, d)),
        "p8_found": lambda s, d: _leaks(s, d).filter("exact").select("doc_id", "item_id"),
        "p8_leaks": _leaks,
        "p8_items": lambda s, d: _leaks(s, d).filter("exact").groupBy("item_id").agg(F.count(F.lit(1)).alias("leaking_docs")),
        "p9_mix": lambda s, d: mixed_documents(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: reached_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_classifier": lambda s, d: classifier_report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: document_units(table(s, d, "documents")),
        "p10_units": lambda s, d: unit_texts(table(s, d, "documents")),
        "p5_rates": lambda s, d: parse_rates(_chunks(s, d)),
    }


_SIMILAR = """with l as (select model, content_hash, vector::double[] v from cache_entries where model is not null and content_hash is not null qualify row_number() over (partition by model, content_hash order by ts desc, loaded_at desc) = 1),
e as (select model, content_hash h, v, sqrt(list_dot_product(v, v)) n from l where v is not null and len(v) = case model when 'codemini-64' then 64 when 'codewide-96' then 96 end
 and len(list_filter(v, lambda x: isfinite(x))) = len(v) and len(list_filter(v, lambda x: x <> 0)) > 0),
s as (select a.model, a.h, b.h o, list_dot_product(a.v, b.v) / (a.n * b.n) score from e a join e b on a.model = b.model and len(a.v) = len(b.v) and a.h <> b.h),
t as (select * from s qualify row_number() over (partition by model, h order by score desc, o) <= 5)
select distinct model, least(h, o) hash_a, greatest(h, o) hash_b from t where score >= 0.85"""

_LEFT_OUT = """with l as (select model, vector::double[] v from cache_entries where model is not null and content_hash is not null qualify row_number() over (partition by model, content_hash order by ts desc, loaded_at desc) = 1),
r as (select model, case when v is null then 'null' when len(v) <> regexp_extract(model, '([0-9]+)$', 1)::int then 'wrong dimension' when len(list_filter(v, lambda x: isfinite(x))) < len(v) then 'not finite' when len(list_filter(v, lambda x: x <> 0)) = 0 then 'all zero' end reason from l)
select model, reason, count(*) entries from r where reason is not null group by all"""

_LEAKED = r"""with w as (select item_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ws, len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}]')) c from eval_items where text is not null),
i as (select id, ws, array_to_string(ws, '') t, c > length(array_to_string(ws, '')) / 4.0 dense from w),
d as (select doc_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ws from documents where text is not null),
ig as (select distinct id, array_to_string(ws[k:k + 11], ' ') g from (select id, ws, unnest(range(1, len(ws) - 10)) k from i where not dense)),
dg as (select distinct id, array_to_string(ws[k:k + 11], ' ') g from (select id, ws, unnest(range(1, len(ws) - 10)) k from d)),
ic as (select distinct id, substr(t, k, 20) g from (select id, t, unnest(range(1, length(t) - 18)) k from i where dense)),
dc as (select distinct id, substr(t, k, 20) g from (select id, t, unnest(range(1, length(t) - 18)) k from (select id, array_to_string(ws, '') t from d)))
select distinct dg.id doc_id, ig.id item_id from dg join ig using (g) union select distinct dc.id, ic.id from dc join ic using (g)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries it can express on whole tables: exhaustive comparison in place of the operators' methods."""
    return {"p2_found": _SIMILAR, "p2_left_out": _LEFT_OUT, "p8_found": _LEAKED, "p8_items": f"select item_id, count(*) leaking_docs from ({_LEAKED}) group by 1"}
