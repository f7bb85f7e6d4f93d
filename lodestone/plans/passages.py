"""Registered queries over chunks: hybrid search, deduplication, contexts and answers, with SQL that folds by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sized import broadcast_if_small
from ..operators import chunking, dense, fusion, grounding, query, sparse
from ..operators import context as ctx
from ..operators.ranking import META
from ..operators.review import review
from ..sources import stores
from ..sources.tables import written
from . import catalog as cat
from . import evaluation, retrieval
from .catalog import register, table
from .config import load, merge

WINDOWS = chunking.Sizes(64, 8, 32)
SMALL = chunking.Sizes(128, 16, 48)


# ---- chunks of the documents, with what an evidence block says of them


def passages(spark, sf_dir: str) -> DataFrame:
    """Fixed windows of all documents, as rows of a chunk store; written once a session."""

    def make():
        made = chunking.chunk(cat.paged(spark, sf_dir, F.col("lang").alias("title"), F.col("source").alias("authority")), "fixed", WINDOWS)
        return written(made.withColumn("id", F.col("chunk_id")).withColumns({"publication_date": F.lit(None).cast("date"), "document_type": F.lit(None).cast("string")}), "passages")

    return cat.once(spark, sf_dir, "passages", make)


def hybrid_retriever(spark, sf_dir: str, settings: dict) -> retrieval.Retriever:
    """BM25 over index texts and hashing vectors of the chunks, fused."""
    p = passages(spark, sf_dir)
    index = cat.once(spark, sf_dir, "passage index", lambda: sparse.build(p, "id", tx.index_text(F.col("text"), F.col("section")), meta=True))
    vectors = cat.once(spark, sf_dir, "passage vectors", lambda: written(dense.packed_vectors(p, "id", F.col("text"), META), "vectors"))

    def by_vector(queries: DataFrame, k: int) -> DataFrame:
        asked = dense.hashed_vectors(queries, "query_id", F.col("text")).withColumnRenamed("id", "query_id")
        return dense.search(vectors, asked.join(queries.select("query_id", "filter"), "query_id") if "filter" in queries.columns else asked, k)

    r = settings["retrieval"]
    return retrieval.hybrid(by_vector, lambda q, k: sparse.search(index, q, k), r["dense_top_k"], r["sparse_top_k"], r["rrf_k"], (r["dense_weight"], r["sparse_weight"]))


_STRIP, _WS = cat._STRIP, cat._WS


def _wlist(t: str) -> str:
    return cat._W.replace("text", t) if t != "text" else cat._W


_PASSAGES = f"""{cat._UNITS}, pw AS (SELECT document_id, ord, page, section, unnest(x) AS word, generate_subscripts(x, 1) AS k FROM (SELECT *, {_WS.format(t='text')} AS x FROM units)),
pg AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord, k) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS total FROM pw),
pc AS (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((i - 63) / 56.0)) AS BIGINT), i // 56)) AS pos FROM pg),
passages AS (SELECT document_id, document_id || ':fixed:' || lpad(CAST(pos AS VARCHAR), 5, '0') AS id, string_agg(word, ' ' ORDER BY i) AS text, min_by(section, i) AS section, min_by(page, i) AS page_start, max(page) AS page_end
  FROM pc WHERE pos = 0 OR (pos - 1) * 56 + 64 < total GROUP BY document_id, pos)"""
_HYBRID = f"""{_PASSAGES}, {cat.bm25_sql("(SELECT id, text || ' ' || coalesce(section, '') AS text FROM passages)", "id")}, {cat.hashed_sql("ph", "passages", "id")}, {cat.hashed_sql("qh", "(SELECT item_id AS id, text FROM benchmark)", "id")},
dots AS (SELECT q.id AS query_id, p.id AS id, sum(q.value * p.value) AS dot FROM qh q JOIN ph p USING (idx) GROUP BY ALL),
near AS (SELECT b.item_id AS query_id, p.id, round(coalesce(dot, 0.0), 6) AS score FROM benchmark b CROSS JOIN passages p LEFT JOIN dots ON dots.query_id = b.item_id AND dots.id = p.id),
lists AS (SELECT query_id, 0 AS list_no, rank, id, 'dense' AS r FROM {cat._top(20, 'near', 'true')} UNION ALL SELECT query_id, 1, rank, id, 'bm25' FROM {cat._top(20)}),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen, array_to_string(list_sort(list_distinct(list(r))), '+') AS sources FROM lists GROUP BY ALL),
hybrid AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INT) AS rank, id, score, sources FROM fused QUALIFY rank <= 20)"""


@register(f"WITH {_HYBRID} SELECT * FROM hybrid WHERE rank <= 10")
def hybrid_chunks(spark, sf_dir):
    return hybrid_retriever(spark, sf_dir, load(env={}))(cat._bench(spark, sf_dir), 10)


# ---- folds over a query's hits, as recursions


def dedup_sql(src: str, out: str, similarity: float) -> str:
    """src(query_id, rank, id, text, document_id, page_start, page_end, ...) without repeats of a higher kept hit."""
    jaccard = "len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))"
    return f"""{out}_s AS MATERIALIZED (SELECT query_id, rank, {cat._SH.format(w='w')} AS s FROM (SELECT query_id, rank, {cat._W} AS w FROM {src})),
{out}_d AS MATERIALIZED (SELECT b.query_id, b.rank, list(a.rank) AS above FROM {src} a JOIN {src} b ON a.query_id = b.query_id AND a.rank < b.rank JOIN {out}_s x ON x.query_id = a.query_id AND x.rank = a.rank JOIN {out}_s y ON y.query_id = b.query_id AND y.rank = b.rank
  WHERE a.id = b.id OR (a.document_id = b.document_id AND b.page_start >= a.page_start AND b.page_end <= a.page_end AND {jaccard} >= 0.5) OR {jaccard} >= {similarity} GROUP BY ALL),
{out}_k(query_id, r, kept) AS (SELECT DISTINCT query_id, 0, CAST([] AS INT[]) FROM {src} UNION ALL
  SELECT k.query_id, k.r + 1, CASE WHEN list_has_any(k.kept, coalesce(d.above, CAST([] AS INT[]))) THEN k.kept ELSE list_append(k.kept, k.r + 1) END
  FROM {out}_k k JOIN {src} h ON h.query_id = k.query_id AND h.rank = k.r + 1 LEFT JOIN {out}_d d ON d.query_id = h.query_id AND d.rank = h.rank),
{out} AS (SELECT h.* REPLACE (CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS INT) AS rank) FROM {src} h JOIN (SELECT query_id, unnest(kept) AS rank FROM (SELECT * FROM {out}_k QUALIFY r = max(r) OVER (PARTITION BY query_id))) USING (query_id, rank))"""


def context_sql(src: str, out: str, budget: int, per_document: int) -> str:
    """(query_id, ids, blocks, used, dropped): the evidence that fits, of src without repeats."""
    skip = f"len(list_filter(c.docs, lambda x: x = b.document_id)) >= {per_document}"
    fits = f"c.used + b.n <= {budget}"
    grown = lambda c, x: f"CASE WHEN {skip} OR NOT {fits} THEN c.{c} ELSE list_append(c.{c}, b.{x}) END"
    return f"""{dedup_sql(src, f'{out}_u', 0.9)},
{out}_b AS MATERIALIZED (SELECT *, CAST(len({_WS.format(t='block')}) AS INT) AS n FROM (SELECT query_id, rank, id, document_id, '[chunk_id: ' || id || '] ' || authority || ' — ' || title || CASE WHEN coalesce(section, '') <> '' THEN ' | §' || section ELSE '' END || ' | '
  || CASE WHEN page_start = page_end THEN 'p.' || page_start ELSE 'pp.' || page_start || '-' || page_end END || ' | None' || chr(10) || {_STRIP.format(t='text')} AS block FROM {out}_u)),
{out}_c(query_id, r, ids, docs, blocks, used, dropped) AS (SELECT DISTINCT query_id, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, 0 FROM {src} UNION ALL
  SELECT c.query_id, c.r + 1, {grown('ids', 'id')}, {grown('docs', 'document_id')}, {grown('blocks', 'block')}, CASE WHEN {skip} OR NOT {fits} THEN c.used ELSE c.used + b.n END, CASE WHEN NOT ({skip}) AND NOT {fits} THEN c.dropped + 1 ELSE c.dropped END
  FROM {out}_c c JOIN {out}_b b ON b.query_id = c.query_id AND b.rank = c.r + 1),
{out} AS (SELECT * FROM {out}_c QUALIFY r = max(r) OVER (PARTITION BY query_id))"""


def answer_sql(src: str, context: str, out: str, asked: str = "benchmark") -> str:
    """(query_id, answer, insufficient, citations, invalid, context_tokens): the extractive model on the shown hits."""
    return f"""{out}_s AS (SELECT h.query_id, rank, h.id, h.text, round(len(list_intersect({cat._CW.format(t='q.text')}, {cat._CW.format(t='h.text')})) / greatest(len({cat._CW.format(t='q.text')}), 1), 6) AS share
  FROM {src} h JOIN {context} c ON c.query_id = h.query_id AND list_contains(c.ids, h.id) JOIN {asked} q ON q.item_id = h.query_id),
{out}_b AS (SELECT *, share >= 0.3 AS enough, {_STRIP.format(t='text')} AS t FROM {out}_s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, rank) = 1),
{out} AS (SELECT item_id AS query_id, CASE WHEN enough THEN substr(CASE WHEN regexp_matches(t, '[.;]\\s') THEN regexp_extract(t, '^(.*?[.;])\\s', 1, 's') ELSE t END, 1, 400) ELSE '{grounding.INSUFFICIENT}' END AS answer, NOT coalesce(enough, false) AS insufficient,
  CASE WHEN enough THEN id ELSE '' END AS citations, '' AS invalid, coalesce(c.used, 0) AS context_tokens FROM {asked} LEFT JOIN {out}_b b ON b.query_id = item_id LEFT JOIN {context} c ON c.query_id = item_id)"""


_ANSWER_COLUMNS = "query_id, answer, insufficient, coalesce(citations, '') AS citations, invalid, context_tokens"


def _doc_hits(k: int) -> str:
    return f"""{cat._BM25}, hits AS MATERIALIZED (SELECT t.query_id, t.rank, CAST(t.id AS VARCHAR) AS id, t.score, text, source AS document_id, 1 AS page_start, 1 AS page_end, CAST(NULL AS VARCHAR) AS section, lang AS title, source AS authority FROM {cat._top(k)} t JOIN documents ON doc_id = t.id)"""


@register(f"WITH RECURSIVE {_doc_hits(20)}, {dedup_sql('hits', 'one', 0.9)} SELECT query_id, rank, id, score FROM one")
def greedy_dedup(spark, sf_dir):
    return fusion.deduplicate(cat._hit_rows(spark, sf_dir)).select("query_id", "rank", "id", "score")


@register(f"WITH RECURSIVE {_doc_hits(20)}, {context_sql('hits', 'cx', 2000, 4)} SELECT query_id, array_to_string(ids, ',') AS ids, md5(array_to_string(blocks, chr(10) || chr(10))) AS digest, used AS token_count, dropped FROM cx")
def contexts(spark, sf_dir):
    out = ctx.build(cat._hit_rows(spark, sf_dir), 2000, 4)
    return out.select("query_id", F.array_join("ids", ",").alias("ids"), F.md5(F.col("context").cast("binary")).alias("digest"), "token_count", "dropped")


def _flat(answers: DataFrame) -> DataFrame:
    return answers.withColumns({c: F.array_join(c, ",") for c in ("citations", "invalid")})


@register(f"WITH RECURSIVE {_doc_hits(8)}, {context_sql('hits', 'cx', 6000, 4)}, {answer_sql('hits', 'cx', 'an')} SELECT {_ANSWER_COLUMNS} FROM an")
def grounded_answers(spark, sf_dir):
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return _flat(retrieval.answer(cat._hit_rows(spark, sf_dir, 8), cat._bench(spark, sf_dir), store, load(env={})))


_SECTION_SQL = "coalesce(p.section, '')"
_TERMS = "list_distinct({t})"


@register(
    f"""WITH RECURSIVE {_HYBRID}, hits AS MATERIALIZED (SELECT h.query_id, h.rank, h.id, p.text, p.document_id, p.page_start, p.page_end, p.section, d.lang AS title, d.source AS authority FROM hybrid h JOIN passages p USING (id) JOIN documents d ON 'd' || d.doc_id = p.document_id),
{dedup_sql('hits', 'one', 0.9)},
ov AS (SELECT o.*, round(len(list_intersect(list_distinct({cat.tok('b.text')}), list_distinct({cat.tok('o.text')}))) / greatest(len(list_distinct({cat.tok('b.text')})), 1), 6) AS overlap FROM one o JOIN benchmark b ON b.item_id = o.query_id),
best AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS INT) AS rank) FROM ov QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) <= 6),
{context_sql('best', 'cx', 300, 2)}, {answer_sql('best', 'cx', 'an')} SELECT {_ANSWER_COLUMNS} FROM an"""
)
def answered_chunks(spark, sf_dir):
    """Every benchmark item from the chunks to its answer: hybrid search, deduplication, reranking, context, extraction."""
    settings = merge(load(env={}), {"context": {"max_tokens": 300, "max_chunks_per_document": 2}, "reranker": {"enabled": True, "candidates": 20, "top_k": 6}})
    q = cat._bench(spark, sf_dir)
    p = passages(spark, sf_dir)
    return _flat(retrieval.answer_questions(q, hybrid_retriever(spark, sf_dir, settings), p, settings))


# ---- contexts of hits whose parents or neighbours are shown in their place


_WIDE_HITS = f"""{_PASSAGES}, {cat.bm25_sql("(SELECT id, text || ' ' || coalesce(section, '') AS text FROM passages)", "id")},
numbered AS MATERIALIZED (SELECT p.*, CAST(right(id, 5) AS INT) AS position, d.lang AS title, d.source AS authority FROM passages p JOIN documents d ON 'd' || d.doc_id = p.document_id),
hits AS MATERIALIZED (SELECT t.query_id, t.rank, p.*, CASE WHEN position % 3 = 0 THEN p.document_id || ':parent' END AS parent_id FROM {cat._top(8)} t JOIN numbered p USING (id)),
{dedup_sql('hits', 'uniq', 0.9)},
around AS MATERIALIZED (SELECT u.query_id, u.rank, string_agg(n.text, chr(10) ORDER BY n.position) AS text, min(n.page_start) AS page_start, max(n.page_end) AS page_end FROM uniq u JOIN numbered n ON n.document_id = u.document_id AND abs(n.position - u.position) <= 1 WHERE u.parent_id IS NULL GROUP BY ALL),
wide AS MATERIALIZED (SELECT u.query_id, u.rank, u.id, u.document_id, u.parent_id, u.section, u.title, u.authority, CASE WHEN u.parent_id IS NOT NULL THEN 'The whole of ' || u.document_id ELSE a.text END AS text, coalesce(a.page_start, u.page_start) AS page_start, coalesce(a.page_end, u.page_end) AS page_end FROM uniq u LEFT JOIN around a USING (query_id, rank)),
shown AS MATERIALIZED (SELECT *, CAST(len({_WS.format(t='block')}) AS INT) AS n FROM (SELECT query_id, rank, id, document_id, parent_id, '[chunk_id: ' || id || '] ' || authority || ' — ' || title || CASE WHEN coalesce(section, '') <> '' THEN ' | §' || section ELSE '' END || ' | '
  || CASE WHEN page_start = page_end THEN 'p.' || page_start ELSE 'pp.' || page_start || '-' || page_end END || ' | None' || chr(10) || {_STRIP.format(t='text')} AS block FROM wide)),
fold(query_id, r, ids, docs, parents, blocks, used, dropped) AS (SELECT DISTINCT query_id, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, 0 FROM hits UNION ALL
  SELECT f.query_id, f.r + 1, CASE WHEN out_ OR NOT fits THEN f.ids ELSE list_append(f.ids, f.id) END, CASE WHEN out_ OR NOT fits THEN f.docs ELSE list_append(f.docs, f.document_id) END, CASE WHEN out_ OR NOT fits OR f.parent_id IS NULL THEN f.parents ELSE list_append(f.parents, f.parent_id) END,
    CASE WHEN out_ OR NOT fits THEN f.blocks ELSE list_append(f.blocks, f.block) END, CASE WHEN out_ OR NOT fits THEN f.used ELSE f.used + f.n END, CASE WHEN NOT out_ AND NOT fits THEN f.dropped + 1 ELSE f.dropped END
  FROM (SELECT c.*, b.id, b.document_id, b.parent_id, b.block, b.n, len(list_filter(c.docs, lambda x: x = b.document_id)) >= 2 OR coalesce(list_contains(c.parents, b.parent_id), false) AS out_, c.used + b.n <= 500 AS fits FROM fold c JOIN shown b ON b.query_id = c.query_id AND b.rank = c.r + 1) f)"""


@register(f"WITH RECURSIVE {_WIDE_HITS} SELECT query_id, array_to_string(ids, ',') AS ids, md5(array_to_string(blocks, chr(10) || chr(10))) AS digest, used AS token_count, dropped FROM fold QUALIFY r = max(r) OVER (PARTITION BY query_id)")
def expanded_contexts(spark, sf_dir):
    """Contexts of chunks: every third has a parent, which is shown once for all its children, the others are shown with their neighbours."""
    p = passages(spark, sf_dir)
    child = F.col("position") % 3 == 0
    parents = {"parent_id": F.when(child, F.concat("document_id", F.lit(":parent"))), "parent_text": F.when(child, F.concat(F.lit("The whole of "), "document_id"))}
    index = cat.once(spark, sf_dir, "passage index", lambda: sparse.build(p, "id", tx.index_text(F.col("text"), F.col("section")), meta=True))
    found = written(sparse.search(index, cat._bench(spark, sf_dir), 8).drop("score"), "lists")
    hits = written(broadcast_if_small(found).join(p.drop("parent_id", "parent_text").withColumns(parents), "id"), "hits")
    out = ctx.build(hits, 500, 2, p, 1)
    return out.select("query_id", F.array_join("ids", ",").alias("ids"), F.md5(F.col("context").cast("binary")).alias("digest"), "token_count", "dropped")


# ---- questions that name sources and documents


PATTERNS = {"documents": {f"d{i}": rf"\bpaper {i}\b" for i in range(40)}, "authorities": {f"src{i}": rf"\bsrc{i}\b" for i in range(20)}}
_ASKED = "asked_items AS MATERIALIZED (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' src' || item_id % 20 WHEN 1 THEN ' paper ' || item_id % 40 ELSE '' END AS text FROM benchmark)"


def _named_questions(spark, sf_dir) -> DataFrame:
    """Benchmark items of which a quarter names a source and a quarter a document; every eighth has an explicit filter, too."""
    i = F.col("query_id")
    named = F.when(i % 4 == 0, F.concat(F.lit(" src"), (i % 20).cast("string"))).when(i % 4 == 1, F.concat(F.lit(" paper "), (i % 40).cast("string"))).otherwise("")
    none = F.array().cast("array<string>")
    explicit = F.struct(F.array(F.lit("src1"), F.lit("src2")).alias("authority"), none.alias("document_type"), none.alias("document_id"), F.lit(None).cast("date").alias("gte"), F.lit(None).cast("date").alias("lte"))
    return cat._bench(spark, sf_dir).select("query_id", F.concat("text", named).alias("text"), F.when(i % 8 == 4, explicit).alias("filter"))


_FILTERED = f"""{_ASKED}, {_PASSAGES}, places AS MATERIALIZED (SELECT p.*, d.source AS authority FROM passages p JOIN documents d ON 'd' || d.doc_id = p.document_id),
{cat.bm25_sql("(SELECT id, text || ' ' || coalesce(section, '') AS text FROM passages)", "id", "asked_items")}, {cat.hashed_sql("ph", "passages", "id")}, {cat.hashed_sql("qh", "(SELECT item_id AS id, text FROM asked_items)", "id")},
dots AS (SELECT q.id AS query_id, p.id AS id, sum(q.value * p.value) AS dot FROM qh q JOIN ph p USING (idx) GROUP BY ALL),
near AS (SELECT b.item_id AS query_id, p.id, round(coalesce(dot, 0.0), 6) AS score FROM benchmark b CROSS JOIN passages p LEFT JOIN dots ON dots.query_id = b.item_id AND dots.id = p.id),
ways AS (SELECT item_id, 1000000 + item_id AS query_id, CASE WHEN item_id % 8 = 4 THEN ['src1', 'src2'] END AS a, CAST(NULL AS VARCHAR) AS d FROM benchmark UNION ALL
  SELECT item_id, item_id, CASE WHEN item_id % 4 = 0 THEN ['src' || item_id % 20] END, CASE WHEN item_id % 4 = 1 THEN 'd' || item_id % 40 END FROM benchmark WHERE item_id % 8 = 0 OR item_id % 4 = 1),
open_near AS (SELECT w.query_id, n.id, n.score FROM ways w JOIN near n ON n.query_id = w.item_id JOIN places p ON p.id = n.id WHERE (w.a IS NULL OR list_contains(w.a, p.authority)) AND (w.d IS NULL OR w.d = p.document_id)),
open_bm AS (SELECT w.query_id, n.id, n.score FROM ways w JOIN scored n ON n.query_id = w.item_id JOIN places p ON p.id = n.id WHERE (w.a IS NULL OR list_contains(w.a, p.authority)) AND (w.d IS NULL OR w.d = p.document_id)),
lists AS (SELECT query_id, 0 AS list_no, rank, id FROM {cat._top(20, 'open_near', 'true')} UNION ALL SELECT query_id, 1, rank, id FROM {cat._top(20, 'open_bm')}),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY ALL),
hits AS MATERIALIZED (SELECT f.query_id, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, seen) AS INT) AS rank, id, text, document_id, page_start, page_end, authority FROM fused f JOIN places USING (id) QUALIFY rank <= 8),
{dedup_sql('hits', 'one', 0.9)},
listed AS (SELECT query_id % 1000000 AS item_id, query_id >= 1000000 AS is_open, rank, id, document_id, authority FROM one),
inferred AS (SELECT item_id, a, d FROM ways WHERE query_id < 1000000),
turns AS (SELECT item_id, id, min(rank * 2 + CAST(is_open AS INT)) AS slot FROM listed WHERE is_open OR item_id IN (SELECT item_id FROM inferred) GROUP BY ALL),
moved AS (SELECT b.item_id, id, rank, CASE WHEN i.item_id IS NOT NULL AND (i.a IS NULL OR list_contains(i.a, authority)) AND (i.d IS NULL OR i.d = document_id) THEN rank - 5 ELSE rank END AS place FROM listed b LEFT JOIN inferred i USING (item_id) WHERE is_open)"""


@register(
    f"""WITH RECURSIVE {_FILTERED} SELECT 'restrict' AS mode, item_id AS query_id, rank, id FROM listed WHERE is_open = (item_id NOT IN (SELECT item_id FROM inferred))
  UNION ALL SELECT 'boost', item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY place, rank) AS INT), id FROM moved
  UNION ALL SELECT 'restrict_with_fallback', item_id, CAST(row_number() OVER w AS INT), id FROM turns WINDOW w AS (PARTITION BY item_id ORDER BY slot) QUALIFY row_number() OVER w <= 8"""
)
def filtered_chunks(spark, sf_dir):
    """Hybrid search over chunks under explicit and inferred filters, in the three modes."""
    q, p, parts = _named_questions(spark, sf_dir), passages(spark, sf_dir), []
    for mode in retrieval.MODES:
        settings = merge(load(env={}), {"retrieval": {"filter_mode": mode}})
        found = retrieval.Search(q, hybrid_retriever(spark, sf_dir, settings), p, settings, patterns=PATTERNS)
        parts.append(found.hits().select(F.lit(mode).alias("mode"), "query_id", "rank", "id"))
    return parts[0].union(parts[1]).union(parts[2])


# ---- an ablation: dense, sparse and hybrid search, the last two over texts with a contextual header


_TRUTH = f"""truth AS MATERIALIZED (SELECT item_id AS query_id, 'd' || id AS document_id, CASE WHEN item_id % 3 = 1 THEN p END AS page FROM (SELECT t.query_id AS item_id, t.id, t.rank FROM (WITH {cat._BM25} SELECT * FROM {cat._top(2)}) t), (VALUES (1), (2)) v(p)
  WHERE (item_id % 3 = 0 AND rank = 1 OR item_id % 3 = 1 AND rank = 2) AND item_id % 5 <> 0 GROUP BY ALL UNION ALL SELECT item_id, 'd' || item_id, NULL FROM benchmark WHERE item_id % 3 = 2 AND item_id % 5 <> 0)"""
_HEADED = "(SELECT p.id, d.source || ' — ' || d.lang || CASE WHEN coalesce(section, '') <> '' THEN ' — ' || section ELSE '' END || chr(10) || p.text AS text FROM passages p JOIN documents d ON 'd' || d.doc_id = p.document_id)"


def _dots(name: str, src: str) -> str:
    return f"""{cat.hashed_sql(name + 'h', src, 'id')}, {name}d AS (SELECT q.id AS query_id, p.id AS id, sum(q.value * p.value) AS dot FROM qh q JOIN {name}h p USING (idx) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT b.item_id AS query_id, p.id, round(coalesce(dot, 0.0), 6) AS score FROM benchmark b CROSS JOIN passages p LEFT JOIN {name}d d ON d.query_id = b.item_id AND d.id = p.id)"""


_STEPS = f"""{_ASKED}, {_PASSAGES}, {_TRUTH}, headed AS {_HEADED}, {cat.bm25_sql('headed', 'id', 'asked_items')}, {cat.hashed_sql("qh", "(SELECT item_id AS id, text FROM asked_items)", "id")}, {_dots('plain_near', 'passages')}, {_dots('head_near', 'headed')},
lists AS (SELECT query_id, 0 AS list_no, rank, id FROM {cat._top(20, 'head_near', 'true')} UNION ALL SELECT query_id, 1, rank, id FROM {cat._top(20)}),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY ALL),
stepped AS (SELECT query_id, rank, id FROM {cat._top(10, 'plain_near', 'true')} UNION ALL SELECT 1000000 + query_id, rank, id FROM {cat._top(10)} UNION ALL SELECT 2000000 + query_id, CAST(row_number() OVER w AS INT), id FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, seen) QUALIFY row_number() OVER w <= 10),
hits AS MATERIALIZED (SELECT s.query_id, s.rank, s.rank AS was, s.id, p.text, p.document_id, p.page_start, p.page_end, p.section, d.lang AS title, d.source AS authority FROM stepped s JOIN passages p USING (id) JOIN documents d ON 'd' || d.doc_id = p.document_id),
{dedup_sql('hits', 'one', 0.9)},
shown AS MATERIALIZED (SELECT * FROM one WHERE was <= 8),
questions AS (SELECT s * 1000000 + item_id AS item_id, text FROM asked_items, range(3) t(s)), {context_sql('shown', 'cx', 6000, 4)}, {answer_sql('shown', 'cx', 'an', 'questions')},
cv AS (SELECT h.query_id, h.rank, t.document_id || coalesce('#' || page, '') AS unit FROM one h JOIN truth t ON t.query_id = h.query_id % 1000000 AND t.document_id = h.document_id WHERE page IS NULL OR page BETWEEN page_start AND page_end),
sz AS (SELECT query_id, count(*) AS n, list(DISTINCT document_id) AS docs FROM truth GROUP BY 1),
fi AS (SELECT query_id, unit, min(rank) AS first FROM cv GROUP BY 1, 2),
g AS (SELECT query_id, count(*) FILTER (first <= 1) AS u1, count(*) FILTER (first <= 5) AS u5, count(*) FILTER (first <= 10) AS u10, min(first) AS best, list(DISTINCT first) AS firsts FROM fi GROUP BY 1),
pr AS (SELECT query_id, count(DISTINCT rank) FILTER (rank <= 3) AS r3 FROM cv GROUP BY 1),
per AS (SELECT a.query_id // 1000000 AS step, i % 5 <> 0 AS answerable, CASE WHEN i % 2 = 0 THEN 'factual' ELSE 'ambiguous' END AS question_type, CASE WHEN i % 4 < 2 THEN 'names_document_or_authority' ELSE 'no_explicit_reference' END AS reference,
  CASE WHEN i % 5 <> 0 THEN round(CASE WHEN n > 0 THEN coalesce(u1, 0) / n ELSE 0.0 END, 6) END AS recall_1, CASE WHEN i % 5 <> 0 THEN round(CASE WHEN n > 0 THEN coalesce(u5, 0) / n ELSE 0.0 END, 6) END AS recall_5, CASE WHEN i % 5 <> 0 THEN round(CASE WHEN n > 0 THEN coalesce(u10, 0) / n ELSE 0.0 END, 6) END AS recall_10,
  CASE WHEN i % 5 <> 0 THEN round(coalesce(r3, 0) / 3, 6) END AS precision_3, CASE WHEN i % 5 <> 0 THEN round(coalesce(1 / best, 0.0), 6) END AS mrr,
  CASE WHEN i % 5 <> 0 THEN round(coalesce(list_sum(list_transform(list_sort(firsts), lambda x: 1 / log2(x + 1))) / (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) t(k) WHERE k <= n), 0.0), 6) END AS ndcg_10,
  CASE WHEN i % 5 <> 0 THEN CASE WHEN c.document_id IS NOT NULL AND EXISTS (SELECT 1 FROM truth t WHERE t.query_id = i AND t.document_id = c.document_id AND (page IS NULL OR page BETWEEN c.page_start AND c.page_end)) THEN 1.0 ELSE 0.0 END END AS citation_correctness,
  CASE WHEN i % 5 <> 0 THEN coalesce(CAST(list_contains(docs, c.document_id) AS INT), 0) / greatest(coalesce(len(docs), 1), 1) END AS citation_completeness,
  CASE WHEN i % 5 <> 0 THEN CAST(NOT insufficient AS DOUBLE) END AS answerable_success, CASE WHEN i % 5 = 0 THEN CAST(insufficient AS DOUBLE) END AS abstention_accuracy,
  context_tokens + len({_WS.format(t='q.text')}) AS prompt_tokens, len({_WS.format(t='answer')}) AS completion_tokens
  FROM (SELECT *, query_id % 1000000 AS i FROM an) a JOIN questions q ON q.item_id = a.query_id LEFT JOIN sz ON sz.query_id = i LEFT JOIN g ON g.query_id = a.query_id LEFT JOIN pr ON pr.query_id = a.query_id LEFT JOIN one c ON c.query_id = a.query_id AND c.id = a.citations)"""
_SHOWN = ["recall_1", "recall_5", "recall_10", "precision_3", "mrr", "ndcg_10", "citation_correctness", "citation_completeness", "answerable_success", "abstention_accuracy"]
_SUMS = ["prompt_tokens", "completion_tokens"]


@register(
    f"""WITH RECURSIVE {_STEPS} SELECT CAST(step AS INT) AS step, question_type, reference, count(*) AS n, count(*) FILTER (answerable) AS answerable, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _SHOWN)},
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)} FROM per GROUP BY GROUPING SETS ((step), (step, question_type), (step, reference))"""
)
def ablation_steps(spark, sf_dir):
    """Three steps over the same chunks, from the search to the means by type and reference; the best documents of a search over whole documents
    are the truth of most items."""
    origin = F.col("lang").alias("title"), F.col("source").alias("authority"), F.lit(None).cast("date").alias("publication_date"), F.lit(None).cast("string").alias("document_type")
    corpus = cat.once(spark, sf_dir, "ablation", lambda: evaluation.Corpus(cat.paged(spark, sf_dir, *origin)))
    i, none = F.col("query_id"), F.array().cast("array<string>")
    best = sparse.search(cat._index(spark, sf_dir), cat._bench(spark, sf_dir), 2).select("query_id", "rank", F.concat(F.lit("d"), F.col("id").cast("string")).alias("d"))
    first = best.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("two"))
    pages = F.when((i % 3 == 1) & F.col("two").isNotNull(), F.array(F.struct(F.col("two").alias("document_id"), F.array(F.lit(1), F.lit(2)).alias("pages"))))
    whole = F.when((i % 3 == 0) & F.col("one").isNotNull(), F.array("one")).when(i % 3 == 2, F.array(F.concat(F.lit("d"), i.cast("string")))).otherwise(none)
    items = _named_questions(spark, sf_dir).drop("filter").join(first, "query_id", "left").select(
        "query_id", "text", (i % 5 != 0).alias("answerable"), F.coalesce(pages, F.array().cast("array<struct<document_id: string, pages: array<int>>>")).alias("evidence"), whole.alias("documents"), none.alias("ids"), F.when(i % 2 == 0, "factual").otherwise("ambiguous").alias("question_type")
    )
    base = merge(load(env={}), {"chunking": {"strategy": "fixed", "max_tokens": WINDOWS.max_tokens, "overlap": WINDOWS.overlap, "child_tokens": WINDOWS.child_tokens}, "retrieval": {"infer_filters": False}})
    headed = {"chunking": {"contextual_header": True}}
    steps = {"dense": {"retrieval": {"type": "dense"}}, "bm25 with header": {"retrieval": {"type": "bm25"}} | headed, "hybrid with header": headed}
    out = evaluation.ablation(items, corpus, base, steps=steps, patterns=PATTERNS)
    return out.select("step", "question_type", "reference", "n", "answerable", *_SHOWN, *_SUMS)


# ---- vectors under a metadata filter


_META = "SELECT vec_id, embedding, 'a' || label % 3 AS authority, 't' || vec_id % 2 AS document_type, 'd' || label AS document_id, CASE WHEN vec_id % 7 <> 0 THEN DATE '2020-01-01' + CAST(vec_id % 500 AS INT) END AS publication_date FROM embeddings"


@register(
    f"""WITH v AS ({_META}), scored AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0
  AND (q.vec_id % 60 <> 0 OR v.authority IN ('a0', 'a1')) AND (q.vec_id % 40 <> 0 OR v.document_type = 't1') AND (q.vec_id % 100 <> 0 OR coalesce(v.publication_date BETWEEN DATE '2020-03-01' AND DATE '2020-09-30', true))) SELECT * FROM {cat._top(10, where='true')}"""
)
def dense_metadata_filter(spark, sf_dir):
    i, none = F.col("id"), F.array().cast("array<string>")
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("a"), (F.col("label") % 3).cast("string")).alias("authority"), F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string")).alias("document_type"),
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"), F.when(F.col("vec_id") % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 500).cast("int"))).alias("publication_date"),
    )
    day = lambda on, d: F.when(on, F.lit(d).cast("date"))
    flt = F.struct(
        F.when(i % 60 == 0, F.array(F.lit("a0"), F.lit("a1"))).otherwise(none).alias("authority"), F.when(i % 40 == 0, F.array(F.lit("t1"))).otherwise(none).alias("document_type"), none.alias("document_id"),
        day(i % 100 == 0, "2020-03-01").alias("gte"), day(i % 100 == 0, "2020-09-30").alias("lte"),
    )
    return dense.search(v, v.where("id % 20 = 0").select(i.alias("query_id"), "vector", flt.alias("filter")), 10)


# ---- packed chunks: a chunk's end follows from where it begins, so packing is a recursion over chunks


def _packed_sql(most: int) -> str:
    """pieces of at most so many tokens, and for each document the sums of tokens before each piece."""
    end = r"regexp_replace(text, '([.!?;])\s+([A-Z(\"''])', '\1' || chr(1) || '\2', 'g')"
    sentence = f"CASE WHEN len({_WS.format(t='x')}) <= {most} THEN [x] ELSE list_transform(generate_series(0, (len({_WS.format(t='x')}) - 1) // {most}), lambda i: array_to_string(list_slice({_WS.format(t='x')}, i * {most} + 1, i * {most} + {most}), ' ')) END"
    return f"""{cat._UNITS}, sentences AS (SELECT document_id, ord, page, section, CASE WHEN len({_WS.format(t='text')}) <= {most} THEN [text] ELSE flatten(list_transform(string_split({end}, chr(1)), lambda x: {sentence})) END AS t FROM units),
pieces AS (SELECT document_id, page, section, text, len({_WS.format(t='text')}) AS n, row_number() OVER (PARTITION BY document_id ORDER BY ord, sub) - 1 AS i FROM (SELECT document_id, ord, page, section, unnest(t) AS text, generate_subscripts(t, 1) AS sub FROM sentences)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY i) AS island FROM (SELECT *, CASE WHEN i > 0 AND section IS NOT DISTINCT FROM lag(section) OVER (PARTITION BY document_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM pieces)),
sums AS (SELECT document_id, [0] || list(s ORDER BY i) AS tot FROM (SELECT document_id, i, sum(n) OVER (PARTITION BY document_id ORDER BY i) AS s FROM pieces) GROUP BY 1)"""


def _groups_sql(most: int) -> str:
    """groups(document_id, g, first, past): sections, small ones merged; gg follows the islands and the start of the last group."""
    return f"""edges AS (SELECT document_id, island, min(i) AS s, max(i) + 1 AS e FROM islands GROUP BY ALL),
gg(document_id, island, start) AS (SELECT document_id, island, s FROM edges WHERE island = 1 UNION ALL
  SELECT gg.document_id, e.island, CASE WHEN tot[e.s + 1] - tot[gg.start + 1] < {most // 4} AND tot[e.e + 1] - tot[gg.start + 1] <= {most} THEN gg.start ELSE e.s END FROM gg JOIN edges e ON e.document_id = gg.document_id AND e.island = gg.island + 1 JOIN sums ON sums.document_id = gg.document_id),
groups AS (SELECT gg.document_id, start AS first, max(e) AS past FROM gg JOIN edges USING (document_id, island) GROUP BY ALL)"""


def _runs_sql(name: str, src: str, most: int, overlap: int) -> str:
    """name(document_id, lo, first, past): runs inside the ranges first to past of src."""
    reach = lambda first, fresh: f"least(hi, greatest({fresh} + 1, len(list_filter(tot, lambda x: x <= tot[{first} + 1] + {most})) - 1))"
    back = f"greatest({name}_r.first, len(list_filter(tot, lambda x: x < tot[{name}_r.past + 1] - {overlap})))"
    return f"""{name}_r(document_id, lo, hi, first, past) AS (SELECT document_id, lo, hi, lo, {reach('lo', 'lo')} FROM (SELECT document_id, first AS lo, past AS hi FROM {src}) JOIN sums USING (document_id) UNION ALL
  SELECT document_id, lo, hi, b, {reach('b', 'past')} FROM (SELECT {name}_r.document_id, lo, hi, past, tot, {back} AS b FROM {name}_r JOIN sums ON sums.document_id = {name}_r.document_id WHERE past < hi)),
{name} AS (SELECT document_id, lo, hi, first, past FROM {name}_r)"""


def _chunks_sql(strategy: str, runs: str, parent: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""SELECT c.document_id, c.document_id || ':{strategy}:' || lpad(CAST(position AS VARCHAR), 5, '0') AS chunk_id, '{strategy}' AS strategy, CAST(position AS INT) AS position, any_value(c.parent_id) AS parent_id,
  md5(string_agg(text, chr(10) ORDER BY i)) AS digest, min_by(section, i) FILTER (coalesce(section, '') <> '') AS section, CAST(min(page) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end, CAST(sum(n) AS INT) AS token_count
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first, past) - 1 AS position, {parent} AS parent_id FROM {runs}) c JOIN pieces p ON p.document_id = c.document_id AND p.i >= c.first AND p.i < c.past GROUP BY c.document_id, position"""


_WHOLE = "whole AS (SELECT document_id, 0 AS first, len(tot) - 1 AS past FROM sums)"
_NUMBERED = "numbered AS (SELECT *, document_id || ':parent:' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY first) - 1 AS VARCHAR), 5, '0') AS parent_id FROM parents)"


def _chunk_query(strategy: str, sql: str) -> None:
    @register(sql)
    def run(spark, sf_dir):
        out = chunking.chunk(cat.paged(spark, sf_dir), strategy, SMALL)
        return out.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text", "parent_text")

    cat.QUERIES[f"{strategy}_chunks"] = cat.QUERIES.pop("run")


_chunk_query("recursive", f"WITH RECURSIVE {_packed_sql(128)}, {_WHOLE}, {_runs_sql('runs', 'whole', 128, 16)} {_chunks_sql('recursive', 'runs')}")
_chunk_query("section", f"WITH RECURSIVE {_packed_sql(128)}, {_groups_sql(128)}, {_runs_sql('runs', 'groups', 128, 16)} {_chunks_sql('section', 'runs')}")
_chunk_query(
    "parent_child",
    f"WITH RECURSIVE {_packed_sql(48)}, {_groups_sql(256)}, {_runs_sql('parents', 'groups', 256, 0)}, {_NUMBERED}, {_runs_sql('runs', 'numbered', 48, 8)} "
    + _chunks_sql("parent_child", "runs", "(SELECT any_value(parent_id) FROM numbered m WHERE m.document_id = runs.document_id AND m.first = runs.lo)"),
)


# ---- several wordings, identities, review


_HALVES = f"""parts AS (SELECT item_id, {_WS.format(t='text')} AS w, text FROM benchmark),
wordings AS (SELECT item_id, 0 AS list_no, text FROM parts UNION ALL SELECT item_id, 1, array_to_string(list_slice(w, 1, greatest(len(w) // 2, 1)), ' ') FROM parts UNION ALL SELECT item_id, 2, array_to_string(list_slice(w, len(w) // 2 + 1, len(w)), ' ') FROM parts),
asked AS (SELECT *, row_number() OVER (ORDER BY item_id, list_no) AS item FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY list_no) - 1 AS list_no, text FROM (SELECT w.* FROM wordings w JOIN parts p USING (item_id) WHERE list_no = 0 OR w.text <> p.text)))"""


@register(
    f"""WITH {_HALVES}, {cat.bm25_sql('documents', 'doc_id', 'asked', 'item')}, l AS (SELECT item_id AS query_id, list_no, rank, id FROM {cat._top(10)} t JOIN asked ON item = t.query_id),
  f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM l GROUP BY ALL)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INT) AS rank, id, score, 'retriever' AS sources FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) <= 10"""
)
def multi_query(spark, sf_dir):
    """Every benchmark item searched by its text, its first half and its second half at once."""
    b = cat._bench(spark, sf_dir)
    w = tx.tokens(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    parts = b.select("query_id", F.col("text").alias("normalised"), F.lit(None).cast("string").alias("rewritten"), F.array(F.array_join(F.slice(w, 1, F.greatest(half, F.lit(1))), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " ")).alias("variants"))
    index = cat._index(spark, sf_dir)
    return retrieval.fan_out(lambda q, k: sparse.search(index, q, k), query.retrieval_queries(parts), 10)


@register(
    r"""WITH p AS (SELECT doc_id, source, CAST(doc_id % 100000 AS INT) AS position, source || ':section:' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS chunk_id FROM documents),
  h AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM p)
  SELECT doc_id, source, position, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"""
)
def point_ids(spark, sf_dir):
    return stores.contextual_ids(table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 100000).cast("int").alias("position")), "source", "section")


_SQUASHED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_REVIEW = f"""{_packed_sql(128)}, {_groups_sql(128)}, {_runs_sql('runs', 'groups', 128, 16)},
ch AS (SELECT c.document_id, c.document_id || ':section:' || lpad(CAST(position AS VARCHAR), 5, '0') AS id, string_agg(text, chr(10) ORDER BY i) AS text, min_by(section, i) FILTER (coalesce(section, '') <> '') AS section, min(page) AS page_start, max(page) AS page_end
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first, past) - 1 AS position FROM runs) c JOIN pieces p ON p.document_id = c.document_id AND p.i >= c.first AND p.i < c.past GROUP BY c.document_id, position),
near AS MATERIALIZED (SELECT b.item_id AS query_id, ch.document_id, ch.id, ch.text, {cat.tok("coalesce(section, '') || ' ' || ch.text")} AS toks, {cat.tok('b.text')} AS q FROM benchmark b JOIN ch ON ch.document_id = 'd' || (b.item_id * 7 % (SELECT count(*) FROM documents)) WHERE page_start <= 4 AND page_end >= 1),
gs AS (SELECT query_id, count(*) AS n, avg(len(toks)) AS mean FROM near GROUP BY 1),
gt AS (SELECT query_id, id, len(toks) AS dl, q, term, count(*) AS tf FROM (SELECT *, unnest(toks) AS term FROM near) GROUP BY ALL),
gd AS (SELECT query_id, term, mean, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT query_id, term, count(*) AS df FROM gt GROUP BY 1, 2) JOIN gs USING (query_id)),
gi AS (SELECT query_id, term, mean, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM gd),
sc AS (SELECT query_id, id, round(sum(len(list_filter(q, lambda x: x = term)) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM gt JOIN gi USING (query_id, term) GROUP BY 1, 2),
rk AS (SELECT query_id, document_id, id, coalesce(score, 0.0) AS score, q, {_SQUASHED} AS t, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, id) AS rank FROM near LEFT JOIN sc USING (query_id, id) QUALIFY rank <= 2),
wn AS (SELECT query_id, id, t, s, len(list_intersect(list_distinct(q), {cat.tok('substr(t, s + 1, 600)')})) AS n FROM (SELECT *, CAST(unnest(range(0, greatest(length(t) - 501, 0) + 1, 100)) AS INT) AS s FROM rk WHERE length(t) > 600)),
bw AS (SELECT query_id, id, arg_max(s, n * 1000000 - s) AS s FROM wn GROUP BY 1, 2)"""


@register(f"WITH RECURSIVE {_REVIEW} SELECT query_id, document_id, CAST(rank AS INT) AS rank, id, score, CASE WHEN length(t) <= 600 THEN t ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, 600) END AS excerpt FROM rk LEFT JOIN bw USING (query_id, id)")
def evidence_review(spark, sf_dir):
    """The two best chunks for each benchmark item on the pages of one document."""
    chunks = cat.once(spark, sf_dir, "sections", lambda: written(chunking.chunk(cat.paged(spark, sf_dir), "section", SMALL), "sections"))
    n = table(spark, sf_dir, "documents").count()
    name = F.concat(F.lit("d"), (F.col("query_id") * 7 % n).cast("string"))
    items = cat._bench(spark, sf_dir).select("query_id", F.col("text").alias("question"), F.array(F.struct(name.alias("document_id"), F.array(F.lit(1), F.lit(4)).alias("pages"))).alias("evidence"))
    return review(items, chunks)
