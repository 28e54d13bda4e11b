"""The named queries over this package's operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm.automaton_dedup import automaton_dedup
from tallyloom.llm.decontamination import contamination, words_covered
from tallyloom.llm.fill_in_middle import fill_in_middle, restored
from tallyloom.llm.jaccard import similarity_classes
from tallyloom.llm.language_model import context_tree_scores
from tallyloom.llm.mixing import mix_sources, word_count
from tallyloom.llm.quality import learn_quality, quality_score
from tallyloom.llm.quantisation import vector_classes
from tallyloom.llm.settings import GOOD, VOCABULARY, fold_of, word_vocabulary
from tallyloom.llm.stratified_index import index_search
from tallyloom.llm.suffix_dedup import suffix_dedup
from tallyloom.llm.threshold_search import top_inner_products
from tallyloom.llm.token_counts import token_counts
from tallyloom.llm.token_output import token_output
from tallyloom.plans.registry import query
from tallyloom.session import frozen, scratch
from tallyloom.sources.tables import Tables


def _n_removed() -> Column:
    return F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r.stop - r.start).alias("n_removed")


@query("op1_token_counts")
def op1(t: Tables) -> DataFrame:
    return token_counts(t.documents, tokenizer=word_vocabulary(), limit=2048)


@query("op2_suffix_dedup")
def op2(t: Tables) -> DataFrame:
    return suffix_dedup(t.documents, span=200).select(
        "doc_id", "n_bytes", _n_removed(), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


JACCARD_SQL = r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
  select distinct doc_id, array_to_string(w[p:p + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), link as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)
), side as (
  select a, b from link union all select b, a from link
), reach as (
  select doc_id as a, doc_id as b from d union select reach.a, side.b from reach join side on side.a = reach.b
)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from d left join n using (doc_id)
join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)
"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3(t: Tables) -> DataFrame:
    return similarity_classes(t.documents, words=5, percent=75).select("doc_id", "n_shingles", "component_id")


@query("op4_context_tree")
def op4(t: Tables) -> DataFrame:
    scores = context_tree_scores(t.documents, train=fold_of() != 1)
    return scores.withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


@query("op5_token_output")
def op5(t: Tables) -> DataFrame:
    return token_output(t.documents, scratch(t.spark, "token-blocks"), tokenizer=word_vocabulary(), vocabulary=VOCABULARY, end_id=1)


@query("op6_vector_classes")
def op6(t: Tables) -> DataFrame:
    return vector_classes(t.embeddings, cosine=0.93)


@query("op7_quality")
def op7(t: Tables) -> DataFrame:
    model = learn_quality(t.documents, t.labels, learn=lambda c: fold_of(c) != 0)
    scored = t.documents.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), quality_score(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


DECONTAMINATE_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), iw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as p from i where len(w) > 0)
), dw as (
  select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from iw) where len(w) >= n)
), hit as (
  select doc_id, p, dw.n, item_id from dw join iw using (win, n)
), cover as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from (select distinct doc_id, p, n from hit)) group by doc_id
), named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from (select distinct doc_id, item_id from hit) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (doc_id) left join named using (doc_id)
"""


@query("op8_decontaminate", DECONTAMINATE_SQL)
def op8(t: Tables) -> DataFrame:
    found = contamination(t.documents, t.benchmark, span=10)
    return found.select(
        "doc_id",
        "n_words",
        words_covered("hits").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


MIX_SQL = r"""
with d as (
  select doc_id, case when source is null then 'z' else 'a' || source end as src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents
), s as (
  select src, sum(size)::bigint as source_size, ((row_number() over (order by src) - 1) % 3 + 1)::bigint as w from d group by src
), lv as (
  select *, 3 * source_size as cap,
    ((sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / w, src rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(w) over (order by 3 * source_size / w, src rows between current row and unbounded following))::double) as lvl,
    row_number() over (order by 3 * source_size / w, src) as pos from s
), t as (
  select src, source_size, least(cap::double, (select arg_min(lvl, pos) from lv where lvl <= cap / w) * w) as target from lv
), r as (
  select d.doc_id, d.size, t.source_size, t.target, t.target / t.source_size as rate,
    ('0x' || substr(md5('mix' || d.src), 1, 8))::bigint::double / 4294967296.0::double as u,
    row_number() over (partition by d.src order by length(bin(d.size)) * 64 + (d.size >> greatest(length(bin(d.size)) - 6, 0)::bigint), d.h, d.doc_id, d.size) as k
  from d join t using (src)
)
select doc_id, size, source_size, target, (least(floor(u + rate * k) - floor(u + rate * (k - 1)), 3))::bigint * size as taken from r
"""


@query("op9_mix_sources", MIX_SQL)
def op9(t: Tables) -> DataFrame:
    sized = frozen(t.documents.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    mixed = mix_sources(sized, doc_id="doc_id", source="source", size=F.col("size"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


EARLIER_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), win as (
  select doc_id, p, array_to_string(w[p:p + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from d where len(w) >= 13)
), least_id as (
  select k, min(doc_id) as m from win group by k
), gone as (
  select distinct doc_id, q from (select doc_id, unnest(range(p, p + 13)) as q from win join least_id using (k) where m < doc_id)
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as t from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) x
  where not exists (select 1 from gone where gone.doc_id = x.doc_id and gone.q = x.i) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, (select count(*) from gone where gone.doc_id = d.doc_id)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""


@query("op10_automaton_dedup", EARLIER_SQL)
def op10(t: Tables) -> DataFrame:
    return automaton_dedup(t.documents, span=13).select("doc_id", "n_words", _n_removed(), F.sha2("kept", 256).alias("kept_sha256"))


TOP_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)
), r as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op11_top_vectors", TOP_SQL)
def op11(t: Tables) -> DataFrame:
    return top_inner_products(t.embeddings, queries=F.col("vec_id") % 100 == 0, k=10, scale=1024)


MIDDLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), x as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
         when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from d
), c as (
  select doc_id, n, form, t, least(a, b) as lo, greatest(a, b) as hi from x
), p as (
  select *, substr(t, 1, lo) as pre, substr(t, lo + 1, hi - lo) as mid, substr(t, hi + 1) as suf from c
)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else t end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""


@query("op12_fill_in_middle", MIDDLE_SQL)
def op12(t: Tables) -> DataFrame:
    return fill_in_middle(t.documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    )


SEARCH_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), size as (
  select count(*)::bigint as docs, sum(len(w))::bigint as terms from d where len(w) > 0
), p as (
  select doc_id, len(w)::bigint as n, unnest(w) as term from d where len(w) > 0
), tf as (
  select doc_id, n, term, count(*)::bigint as tf from p group by all
), weight as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, size group by term, docs
), q as (
  select item_id, term, count(*)::bigint as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
  ) group by all
), s as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
  from q join weight using (term) join tf using (term), size group by item_id, doc_id
), r as (
  select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from s where score > 0
)
select item_id, rank, doc_id, score from r where rank <= 10
"""


@query("op13_ranked_search", SEARCH_SQL)
def op13(t: Tables) -> DataFrame:
    return index_search(t.documents, t.benchmark, scratch(t.spark, "strata"), k=10)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(t: Tables) -> DataFrame:
    return corpus_pipeline.run(t.spark, t.root)
