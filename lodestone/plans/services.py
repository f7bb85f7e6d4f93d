"""Registered queries over stores, providers, requests, traces and evaluation items, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as ctx
from ..operators import metrics, providers, query
from ..sources import documents as src
from ..sources import stores
from ..sources.tables import folder, written
from ..streaming import traces
from . import catalog as cat
from .catalog import register, table

_TOP5 = f"WITH {cat._BM25}, top AS (SELECT * FROM {cat._top(5)})"


# ---- stores: what is written is read again


@register("""WITH a AS (SELECT 'c' || vec_id AS chunk_id, label, 0 AS b FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 'c' || vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 2 = 0)
  SELECT chunk_id, CAST(max_by(label, b) AS INT) AS label, count(*) OVER () AS points FROM a GROUP BY 1""")
def vector_collection(spark, sf_dir):
    """A collection that is made, made anew, and then gets a second batch over part of its ids."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), "vec_id", F.col("embedding").alias("vector"), "label")
    store = stores.VectorTable(spark, f"{folder(spark)}/collections/{uuid.uuid4().hex}")
    store.recreate(v.drop("vec_id"))
    store.recreate(v.where("vec_id % 3 = 0").drop("vec_id"))
    store.upsert(v.where("vec_id % 2 = 0").drop("vec_id").withColumn("label", F.col("label") + 100))
    return store.scan().select("chunk_id", F.col("label").cast("int").alias("label"), F.lit(store.count()).cast("long").alias("points"))


@register("SELECT doc_id, md5(text) AS digest, len(string_split(text, ' ')) AS size, true AS known FROM documents")
def cached_values(spark, sf_dir):
    """A cache that is filled for a third of the documents, then asked for all of them."""
    d = table(spark, sf_dir, "documents")
    size = lambda rows: rows.select("key", F.size(F.split("text", " ")).alias("value"))
    empty = d.select(F.lit("").alias("key"), F.lit(0).alias("value")).limit(0)
    _, fresh = stores.cached(d.where("doc_id % 3 = 0"), empty, "m", "text", size)
    cache = written(fresh, "cache")
    got, more = stores.cached(d, cache, "m", "text", size)
    return got.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("value").cast("long").alias("size"), F.col("value").isNotNull().alias("known"))


@register("SELECT conv_id, turn, length(text) || ' characters' AS reply FROM conversations")
def cached_replies(spark, sf_dir):
    """Every turn as a prompt: half of the replies come from a cache, the others from the model, each prompt once."""
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("count").alias("system"), F.col("text").alias("user"))
    model = lambda rows: [f"{len(u)} characters" for _, u in rows]
    empty = spark.createDataFrame([], "key string, reply string")
    _, fresh = providers.generate_cached(prompts.where("conv_id % 2 = 0"), empty, "m", model)
    got, _ = providers.generate_cached(prompts, written(fresh, "replies"), "m", model)
    return got.select("conv_id", "turn", "reply")


_ITEMS = """i AS (SELECT item_id, CAST(item_id AS VARCHAR) AS id, text, item_id % 5 <> 0 AS answerable, CASE WHEN item_id % 3 = 0 THEN ['d' || item_id, 'a' || item_id] ELSE [] END AS ev FROM benchmark)"""


@register(f"""WITH {_ITEMS} SELECT id, answerable, CASE WHEN len(ev) > 0 THEN 'a' || item_id || ',d' || item_id WHEN item_id % 3 = 1 THEN 'given' ELSE '' END AS documents, concat_ws('; ', CASE WHEN answerable AND item_id % 3 = 2 THEN 'answerable without ground truth' END, CASE WHEN item_id % 7 = 0 THEN 'unknown question type' END) AS problems, CASE WHEN item_id % 7 = 0 THEN 'riddle' WHEN item_id % 7 = 1 THEN 'factual' ELSE 'terminology' END AS question_type FROM i""")
def eval_set(spark, sf_dir):
    """Evaluation items through a JSON lines file: documents follow from evidence, items without ground truth are problems."""
    i = F.col("item_id")
    piece = lambda p: F.struct(F.concat(F.lit(p), i.cast("string")).alias("document_id"), F.array(F.lit(1), F.lit(2)).alias("pages"))
    rows = table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("id"), F.col("text").alias("question"), (i % 5 != 0).alias("answerable"), F.when(i % 7 == 0, "riddle").when(i % 7 > 1, "terminology").alias("question_type"),
        F.when(i % 3 == 1, F.array(F.lit("given"))).alias("relevant_document_ids"), F.when(i % 3 == 0, F.array(piece("d"), piece("a"))).alias("relevant_evidence"),
    )
    path = f"{folder(spark)}/evalsets/{uuid.uuid4().hex}"
    stores.write_jsonl(rows, path)
    items, problems = stores.eval_items(spark, path)
    bad = problems.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("problems"))
    return items.join(bad, "id", "left").select("id", "answerable", F.array_join("relevant_document_ids", ",").alias("documents"), F.coalesce("problems", F.lit("")).alias("problems"), "question_type")


@register(f"""{_TOP5} SELECT CAST(item_id AS VARCHAR) AS request_id, text AS query, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank), '') AS retrieved, round(coalesce(sum(score), 0.0), 4) AS total, CAST(3 + item_id % 4 AS INT) AS prompt_tokens, item_id % 2 = 0 AS insufficient_evidence, round((3 + item_id % 4) * 0.15 / 1000000 + 2 * 0.6 / 1000000, 10) AS cost
  FROM benchmark LEFT JOIN top ON query_id = item_id GROUP BY ALL""")
def trace_records(spark, sf_dir):
    """Traces of all benchmark items, written as JSON lines and read again."""
    from ..operators import sparse

    q = cat._bench(spark, sf_dir)
    hits = sparse.search(cat._index(spark, sf_dir), q, 5).withColumn("id", F.col("id").cast("string"))
    shown = q.select("query_id", F.array().cast("array<string>").alias("ids"), F.concat(F.lit("a b c"), F.repeat(F.lit(" x"), (F.col("query_id") % 4).cast("int"))).alias("context"))
    answers = q.select("query_id", F.lit("two words").alias("answer"), (F.col("query_id") % 2 == 0).alias("insufficient"), F.array().cast("array<string>").alias("invalid"))
    path = f"{folder(spark)}/traces/{uuid.uuid4().hex}"
    rows = traces.records(q, hits, shown, answers, "bm25", price=(0.15, 0.6))
    stores.write_jsonl(rows.where("CAST(request_id AS int) % 2 = 0"), path, append=True)
    stores.write_jsonl(rows.where("CAST(request_id AS int) % 2 = 1"), path, append=True)
    back = stores.read_jsonl(spark, path, traces.TRACE)
    total = F.round(F.aggregate("retrieval_scores", F.lit(0.0), lambda a, x: a + x), 4)
    return back.select("request_id", "query", F.array_join("retrieved_chunk_ids", ",").alias("retrieved"), total.alias("total"), "prompt_tokens", "insufficient_evidence", F.round("estimated_cost", 10).alias("cost"))


# ---- lines with fonts: every line of a document is a span whose size, weight and font follow from its place


_SPANS = r"""l AS (SELECT 'd' || doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
sp AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t, CAST(CASE n % 4 WHEN 0 THEN 12.04 WHEN 1 THEN 9.0 ELSE 9.02 END AS DOUBLE) AS size, n % 3 = 0 AS bold FROM l),
b AS (SELECT document_id, arg_min(size, (-m, seen)) AS body FROM (SELECT document_id, round(size, 1) AS size, sum(length(line)) AS m, min(n) AS seen FROM sp WHERE trim(line, ' ') <> '' GROUP BY document_id, round(size, 1)) GROUP BY 1)"""


def _span_rows(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "t"))
    size = F.when(F.col("n") % 4 == 0, 12.04).when(F.col("n") % 4 == 1, 9.0).otherwise(9.02)
    one = F.struct(F.col("t").alias("text"), size.alias("size"), F.lit(0).alias("flags"), F.when(F.col("n") % 3 == 0, F.lit("Serif-Bold")).otherwise(F.lit("Serif")).alias("font"))
    return d.select("document_id", F.lit(1).alias("page_number"), (F.col("n") / 5).cast("int").alias("block"), F.col("n").alias("line"), F.array(one).alias("spans"), F.lit(None).cast("string").alias("error"))


@register(f"WITH {_SPANS} SELECT d.document_id, CAST(coalesce(body, 10.0) AS DOUBLE) AS body_size FROM (SELECT DISTINCT document_id FROM l) d LEFT JOIN b USING (document_id)")
def body_sizes(spark, sf_dir):
    return src.body_sizes(_span_rows(spark, sf_dir))


_STRUCTURAL = r"^(TITLE|Title|CHAPTER|Chapter|SECTION|Section|ARTICLE|Article|ANNEX|Annex|Recommendation|RECOMMENDATION)\s+[IVXLC\d]+[a-z]?$"
_KIND = rf"""CASE WHEN NOT regexp_matches(t, '[A-Za-z]') THEN CASE WHEN regexp_matches(t, '^([A-Z]|\d+(\.\d+){{0,3}})\.?$') AND bold THEN 'marker' ELSE 'body' END WHEN regexp_matches(t, '{_STRUCTURAL}') THEN 'marker'
  WHEN length(t) < 4 OR length(t) > 110 OR regexp_matches(t, '[.,;:]$') THEN 'body' WHEN size >= body + 2.0 OR (bold AND size >= body - 0.5) THEN 'heading' ELSE 'body' END"""


@register(f"WITH {_SPANS} SELECT document_id, CAST(n // 5 AS INT) AS block, CAST(n AS INT) AS line, md5(t) AS digest, {_KIND} AS kind FROM sp JOIN b USING (document_id) WHERE t <> ''")
def line_kinds(spark, sf_dir):
    return src.classified_lines(_span_rows(spark, sf_dir)).select("document_id", "block", "line", F.md5(F.col("text").cast("binary")).alias("digest"), "kind")


#: Pages as in sources.documents.page_lines: runs of markers with the line behind them, headings that go on, blocks' ends.
_PAGES = rf"""k AS (SELECT document_id, n // 5 AS block, n, t, {_KIND} AS kind FROM sp JOIN b USING (document_id) WHERE t <> ''),
r AS (SELECT *, count(*) FILTER (kind <> 'marker') OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, kind <> 'marker' AND coalesce(lead(block) OVER (PARTITION BY document_id ORDER BY n) <> block, true) AS gap FROM k),
e AS (SELECT document_id, run, coalesce(string_agg(t, ' ' ORDER BY n) FILTER (kind = 'marker'), '') AS lead, max_by(kind, n) AS kind, max_by(t, n) AS t, max_by(block, n) AS last_block, min(block) AS block, bool_or(gap) AS gap FROM r GROUP BY ALL),
f AS (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY run) AS pk, lag(last_block) OVER (PARTITION BY document_id ORDER BY run) AS pb FROM e),
g AS (SELECT *, sum(CASE WHEN coalesce(kind = 'heading' AND pk = 'heading' AND pb = block, false) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY run) AS island, regexp_replace(CASE WHEN lead <> '' THEN lead || ' ' || t ELSE t END, '[ *]+$', '') AS h FROM f),
x AS (SELECT document_id, island, min(run) AS run, any_value(kind) AS kind, string_agg(h, ' ' ORDER BY run) AS h, min_by(lead, run) AS lead, min_by(t, run) AS t, max_by(gap, run) AS gap FROM g GROUP BY 1, 2)"""
_PAGE_TEXT = r"""CASE WHEN kind = 'heading' THEN ['', h, ''] WHEN lead <> '' THEN ['', lead, ''] ELSE [] END || CASE WHEN kind = 'body' THEN [t] ELSE [] END || CASE WHEN gap THEN [''] ELSE [] END"""


@register(f"""WITH {_SPANS}, {_PAGES}
  SELECT document_id, md5(array_to_string(flatten(list({_PAGE_TEXT} ORDER BY run)), chr(10))) AS digest, coalesce(string_agg(CASE WHEN kind = 'heading' THEN h WHEN lead <> '' AND regexp_matches(lead, '{_STRUCTURAL}') THEN lead END, '|' ORDER BY run), '') AS headings FROM x GROUP BY 1""")
def page_lines(spark, sf_dir):
    out = src.page_lines(_span_rows(spark, sf_dir))
    return out.select("document_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("headings", "|").alias("headings"))


# ---- models behind functions


def _letters(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@register("SELECT item_id AS id, n AS chars, e, s, role FROM (SELECT item_id, length(p || text) AS n, length(p || text) - length(replace(p || text, 'e', '')) AS e, length(p || text) - length(replace(p || text, ' ', '')) AS s, role FROM benchmark, (VALUES ('query', 'query: '), ('document', 'passage: ')) t(role, p))")
def prefixed_embeddings(spark, sf_dir):
    """An embedding model of the e5 family by name: queries and documents get their own prefixes."""
    embed = providers.embedder("local", "letters-e5-small", lambda: _letters)
    b = table(spark, sf_dir, "benchmark")
    parts = [embed(b, "item_id", F.col("text"), role == "query").withColumn("role", F.lit(role)) for role in ("query", "document")]
    n = lambda i: F.col("vector")[i].cast("long")
    return metrics.union_all(parts).select("id", n(0).alias("chars"), n(1).alias("e"), n(2).alias("s"), "role")


@register(f"""WITH {cat._BM25}, h AS (SELECT * FROM {cat._top(10)}), m AS (SELECT h.query_id, h.rank, h.id, h.score AS pre, (length(b.text) * 31 + length(d.text) * 17) % 101 / 101.0 AS s FROM h JOIN documents d ON doc_id = h.id JOIN benchmark b ON item_id = h.query_id)
  SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, id, round(s, 6) AS score, pre AS pre_rerank_score FROM m WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, rank) QUALIFY row_number() OVER w <= 4""")
def model_rerank(spark, sf_dir):
    from ..operators import sparse

    q = cat._bench(spark, sf_dir)
    hits = sparse.search(cat._index(spark, sf_dir), q, 10).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    out = providers.rerank(hits, q, lambda pairs: [(len(a) * 31 + len(b) * 17) % 101 / 101.0 for a, b in pairs], 4)
    return out.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "pre_rerank_score")


@register("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN round(length(text) % 11 / 10.0, 6) END AS faithfulness, CASE WHEN turn % 3 = 0 THEN CAST(1 AS DOUBLE) END AS answer_relevance, CASE WHEN turn % 3 = 0 THEN CAST(0.5 AS DOUBLE) END AS context_relevance FROM conversations WHERE NOT (turn % 3 = 0 AND length(text) % 11 > 10)""")
def judged_answers(spark, sf_dir):
    """A judge that answers every third turn well, others with a score out of range or none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("kind "), (F.col("turn") % 3).cast("string")).alias("question"), F.col("text").alias("answer"), F.lit("evidence").alias("context"))

    def model(prompts: list[tuple[str, str]]) -> list[str]:
        out = []
        for _, user in prompts:
            answer = user.split("\nANSWER: ", 1)[1]
            first = len(answer) % 11 / 10
            out.append({"0": f'graded: {{"faithfulness": {first}, "answer_relevance": 1, "context_relevance": 0.5}}', "1": '{"faithfulness": 1.5, "answer_relevance": 1, "context_relevance": 0.5}'}.get(user.split("QUESTION: kind ", 1)[1][0], "no idea"))
        return out

    score = lambda n: F.round(f"judge_{n}", 6).alias(n)
    return providers.judge(rows, model).select("conv_id", "turn", *[score(n) for n in providers.SCORES])


@register(f"""WITH b AS (SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)
  SELECT query_id, 0 AS list_no, 'better ' || length(t) AS text FROM b UNION ALL SELECT query_id, 1, 'one' FROM b UNION ALL SELECT query_id, 2, 'two ' || length(t) FROM b""")
def reworded_queries(spark, sf_dir):
    """A model's better wording in quotes, and two variants with list marks; a third line is too many."""
    q = cat._bench(spark, sf_dir).withColumn("normalised", tx.squash(F.col("text")))

    def model(prompts: list[tuple[str, str]]) -> list[str]:
        size = [len(user.split("\n", 1)[1]) for _, user in prompts]
        return [f'"better {n}"' if user.startswith("Word") else f"- one\n\n• two {n}\nthree" for n, (_, user) in zip(size, prompts)]

    return query.retrieval_queries(providers.reworded(q, model, n=2)).select("query_id", F.col("list_no").cast("int").alias("list_no"), "text")


@register(f"""SELECT conv_id, turn, '{ctx.PROMPTS["v1"].replace("'", "''")}' AS system, 'EVIDENCE:' || chr(10) || role || chr(10) || chr(10) || 'QUESTION: ' || text AS user FROM conversations""")
def prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("context"), F.col("text").alias("question"))
    return ctx.prompts(c, "v1").select("conv_id", "turn", "system", "user")


# ---- requests, and relevance of hits


_BODY = """CASE item_id % 7 WHEN 0 THEN '{"query": "  a "}' WHEN 1 THEN '{"query": "long enough", "top_k": ' || item_id || '}' WHEN 2 THEN '{"query": "long enough", "limit": 3}' WHEN 3 THEN '{"query": "long enough", "filters": {"authority": ["EBA", "' || CASE WHEN item_id % 2 = 0 THEN 'ECB' ELSE 'XX' END || '"]}}'
  WHEN 4 THEN '{"query": "long enough", "filters": {"colour": "red"}}' WHEN 5 THEN 'not json' ELSE '{"query": "' || repeat('x', 990 + CAST(item_id AS INT)) || '", "debug": true}' END"""


@register(f"""SELECT item_id, CASE item_id % 7 WHEN 0 THEN 'query too short' WHEN 1 THEN CASE WHEN item_id BETWEEN 1 AND 50 THEN NULL ELSE 'top_k out of range' END WHEN 2 THEN 'unknown field' WHEN 3 THEN CASE WHEN item_id % 2 = 0 THEN NULL ELSE 'unknown authority' END
  WHEN 4 THEN 'unknown field' WHEN 5 THEN 'not a JSON object' ELSE CASE WHEN 990 + item_id > 1000 THEN 'query too long' END END AS problem FROM benchmark""")
def request_problems(spark, sf_dir):
    bodies = table(spark, sf_dir, "benchmark").withColumn("body", F.expr(_BODY))
    return providers.parse_requests(bodies, src.AUTHORITIES).select("item_id", "problem")


_RELEVANCE = f"""{_TOP5.replace("top AS", "hits AS")}, h AS (SELECT query_id, rank, CAST(id AS VARCHAR) AS id, source AS document_id, id % 40 + 1 AS page_start, id % 40 + 6 AS page_end FROM hits JOIN documents ON doc_id = id),
ev AS (SELECT item_id AS query_id, 'src' || ((item_id * 3 + j) % 20) AS document_id, CASE WHEN item_id % 4 = 0 THEN p END AS page FROM benchmark, range(5) a(j), (VALUES (5), (20)) t(p) WHERE item_id % 4 < 2 GROUP BY ALL),
nm AS (SELECT DISTINCT query_id, id FROM h WHERE query_id % 4 > 0 AND rank IN (2, 4)),
al AS (SELECT nm.* FROM nm WHERE query_id NOT IN (SELECT query_id FROM ev)),
cv AS (SELECT h.query_id, rank, 'id:' || id AS unit, h.query_id IN (SELECT query_id FROM al) AS counted FROM h JOIN nm USING (query_id, id)
  UNION ALL SELECT h.query_id, h.rank, h.document_id || coalesce('#' || page, ''), true FROM h JOIN ev ON ev.query_id = h.query_id AND ev.document_id = h.document_id WHERE (page IS NULL OR page BETWEEN page_start AND page_end) AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.query_id = h.query_id AND nm.id = h.id)),
sz AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, document_id || coalesce('#' || page, '') AS u FROM ev UNION SELECT query_id, id FROM al) GROUP BY 1),
fi AS (SELECT query_id, unit, min(rank) AS first, bool_or(counted) AS counted FROM cv GROUP BY 1, 2)"""
_RM = ", ".join(f"round(CASE WHEN coalesce(n, 0) > 0 THEN coalesce((SELECT count(*) FROM fi WHERE fi.query_id = item_id AND first <= {k} AND counted), 0) / n ELSE 0.0 END, 6) AS recall_{k}, round(coalesce((SELECT count(DISTINCT rank) FROM cv WHERE cv.query_id = item_id AND rank <= {k}), 0) / {k}, 6) AS precision_{k}, CAST(coalesce((SELECT count(*) FROM cv WHERE cv.query_id = item_id AND rank <= {k}), 0) > 0 AS DOUBLE) AS hit_{k}" for k in metrics.KS)


@register(f"""WITH {_RELEVANCE.removeprefix('WITH ')} SELECT item_id AS query_id, {_RM}, round(coalesce(1 / (SELECT min(rank) FROM cv WHERE cv.query_id = item_id), 0.0), 6) AS mrr,
  round(CASE WHEN coalesce(n, 0) > 0 THEN coalesce((SELECT sum(1 / log2(first + 1)) FROM (SELECT DISTINCT query_id, first FROM fi) x WHERE x.query_id = item_id), 0.0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) ELSE 0.0 END, 6) AS ndcg_10 FROM benchmark LEFT JOIN sz ON sz.query_id = item_id""")
def hit_relevance(spark, sf_dir):
    """Items with pages, with whole documents, with both documents and named chunks, and with named chunks alone."""
    from ..operators import sparse

    q = cat._bench(spark, sf_dir)
    i = F.col("query_id")
    hits = sparse.search(cat._index(spark, sf_dir), q, 5).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id")), "id")
    hits = hits.select("query_id", "rank", F.col("id").cast("string").alias("id"), "document_id", (F.col("id") % 40 + 1).alias("page_start"), (F.col("id") % 40 + 6).alias("page_end"))
    names = F.array(*[F.concat(F.lit("src"), ((i * 3 + j) % 20).cast("string")) for j in range(5)])
    named = hits.where((i % 4 > 0) & F.col("rank").isin(2, 4)).groupBy("query_id").agg(F.collect_list("id").alias("ids"))
    none = F.array().cast("array<string>")
    items = q.select(
        "query_id", F.when(i % 4 == 0, F.transform(names, lambda n: F.struct(n.alias("document_id"), F.array(F.lit(5), F.lit(20)).alias("pages")))).alias("evidence"), F.when(i % 4 == 1, names).otherwise(none).alias("documents")
    ).join(named, "query_id", "left").withColumn("ids", F.coalesce("ids", none))
    covered, sizes = metrics.relevance(hits, items)
    return metrics.retrieval_metrics(covered, q, sizes)
