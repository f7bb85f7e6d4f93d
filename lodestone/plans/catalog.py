"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sized import broadcast_if_small, spread
from ..operators import chunking, cleaning, dense, fusion, grounding, metrics, query, sparse, validation
from ..operators import context as ctx
from ..operators.ranking import top_k
from ..sources import stores, tables
from ..streaming import traces
from . import retrieval

QUERIES: dict[str, tuple] = {}
PAGE_LINES = 6


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---- the tables' stand-ins: a document's pages are groups of lines, every other page begins with a heading


def paged(spark: SparkSession, sf_dir: str, *own: Column) -> DataFrame:
    """(document_id, pages, the columns own): documents as the chunkers take them."""

    def pages(lines):
        def page(i):
            first = F.substring(F.element_at(lines, i * PAGE_LINES + 1), 1, 40)
            heads = F.when(i % 2 == 0, F.array(first)).otherwise(F.array().cast("array<string>"))
            body = F.array_join(F.slice(lines, i * PAGE_LINES + 1, PAGE_LINES), "\n")
            return F.struct((i + 1).alias("page_number"), body.alias("text"), F.lit(None).cast("string").alias("section"), heads.alias("headings"))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / PAGE_LINES).cast("int")), page)

    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return chunking.carry_sections(spread(table(spark, sf_dir, "documents")).select(name.alias("document_id"), tx.let(F.split("text", "\n"), pages).alias("pages"), *own))


def flat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.page_number").alias("page_number"), F.col("p.text").alias("text"))


_LINES = r"""
lines AS (SELECT 'd' || doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
pages AS (SELECT document_id, n // 6 + 1 AS page_number, string_agg(line, chr(10) ORDER BY n) AS text, substr(min_by(line, n), 1, 40) AS first_line FROM lines GROUP BY 1, 2)
"""
_TOK = r"list_filter(list_transform(regexp_extract_all({t}, '\d+(?:[./]\d+)*(?:\(\d+\))*[a-z]?|[a-z]+(?:[-''][a-z]+)*', 0, 'i'), lambda x: lower(x)), lambda x: x NOT IN ({s}))"
_STOP = ", ".join(f"'{s}'" for s in tx.STOPWORDS)


def tok(t: str) -> str:
    return _TOK.format(t=t, s=_STOP)


_WS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_KEY = r"regexp_replace(lower(" + _STRIP + r"), '\d+', '#', 'g')"


# ---- text, tokens, identities


@register(f"SELECT doc_id, CAST(len({_WS.format(t='text')}) AS INT) AS n_tokens, CAST(len({tok('text')}) AS INT) AS n_terms FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"), F.size(tx.sparse_tokens(F.col("text"))).alias("n_terms"))


@register(r"""SELECT doc_id, chunk_id, sha1_ AS text_hash, cache_key FROM (SELECT doc_id, source || ':section:' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS chunk_id,
  sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS sha1_, sha256('hashing' || chr(0) || text) AS cache_key FROM documents)""")
def identities(spark, sf_dir):
    position = (F.col("doc_id") % 100000).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", tx.chunk_id(F.col("source"), F.lit("section"), position).alias("chunk_id"), tx.text_hash(F.col("text")).alias("text_hash"), tx.cache_key(F.lit("hashing"), F.col("text")).alias("cache_key"))


@register("SELECT doc_id, md5(source || ' — ' || lang || chr(10) || text) AS digest FROM documents")
def index_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.index_text(F.col("text"), F.lit(None), F.col("lang"), F.col("source")).cast("binary")).alias("digest"))


# ---- cleaning


_EDGES = _LINES + f""", trimmed AS (SELECT document_id, page_number, {_KEY.format(t='line')} AS k, row_number() OVER w AS i, count(*) OVER (PARTITION BY document_id, page_number) AS m
  FROM (SELECT document_id, n // 6 + 1 AS page_number, line, n FROM lines WHERE {_STRIP.format(t='line')} <> '') WINDOW w AS (PARTITION BY document_id, page_number ORDER BY n)),
sizes AS (SELECT document_id, count(*) AS pages FROM pages GROUP BY 1 HAVING count(*) >= 3),
repeated AS (SELECT document_id, k AS line, count(*) AS n FROM (SELECT DISTINCT document_id, page_number, k FROM trimmed
    WHERE i <= greatest(1, least(3, m // 4)) OR i > m - greatest(1, least(3, m // 4))) JOIN sizes USING (document_id) WHERE k <> ''
  GROUP BY 1, 2, pages HAVING count(*) >= greatest(2, floor(pages * 0.2)))"""


@register(f"WITH {_EDGES} SELECT document_id, line, n FROM repeated")
def repeated_lines(spark, sf_dir):
    return cleaning.repeated_lines(flat_pages(spark, sf_dir), 0.2)


@register(
    f"""WITH {_EDGES} SELECT document_id, page_number, md5(coalesce(string_agg(line, chr(10) ORDER BY n), '')) AS digest
  FROM (SELECT p.document_id, p.page_number, l.n, CASE WHEN r.line IS NULL AND NOT regexp_matches(l.line, '(?i)^\\s*(page\\s*)?\\d{{1,4}}(\\s*(/|of)\\s*\\d{{1,4}})?\\s*$') THEN l.line END AS line
    FROM pages p JOIN lines l ON p.document_id = l.document_id AND l.n // 6 + 1 = p.page_number LEFT JOIN repeated r ON r.document_id = p.document_id AND r.line = {_KEY.format(t='l.line')})
  GROUP BY 1, 2"""
)
def removed_lines(spark, sf_dir):
    pages = flat_pages(spark, sf_dir)
    out = cleaning.remove_lines(pages, cleaning.repeated_lines(pages, 0.2))
    return out.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.md5(F.col("text").cast("binary")).alias("digest"))


_UNWRAP = r"""
u AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform(string_split(regexp_replace(replace(text, chr(13), ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), chr(10)),
    lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')) AS x FROM documents)),
j AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u),
t AS (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN s WHEN s <> '' AND b <> '' AND NOT regexp_matches(s, '^([•\-–▪*]|\(?[a-z0-9]{1,3}[.)]|\d+(\.\d+)*\s)') AND NOT regexp_matches(b, '[.:;]$')
    THEN ' ' || s ELSE chr(10) || s END, '' ORDER BY i) AS x FROM j GROUP BY 1)"""


@register(f"WITH {_UNWRAP} SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t\u00a0]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM t")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaning.clean(F.col("text")).cast("binary")).alias("digest"))


# ---- validation and the ingestion report: every source is a document, its rows are pages


def _source_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc_order"), F.lit(1).alias("page_number"), "text", "source")


_HASH = r"sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
_CHECK = f"""h AS (SELECT doc_id, text, {_HASH} AS h, length(text) < 80 AS short FROM documents),
s AS (SELECT doc_id, text, CASE WHEN short THEN 'near_empty' WHEN doc_id = min(doc_id) FILTER (NOT short) OVER (PARTITION BY h) THEN 'kept' ELSE 'duplicate' END AS status FROM h)"""


@register(f"WITH {_CHECK} SELECT doc_id, status FROM s")
def page_status(spark, sf_dir):
    return validation.check_pages(_source_pages(spark, sf_dir)).select(F.col("doc_order").alias("doc_id"), "status")


@register(f"WITH h AS (SELECT doc_id, {_HASH} AS h FROM documents), m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM h) SELECT doc_id, CASE WHEN first <> doc_id THEN CAST(first AS VARCHAR) END AS same_as FROM m")
def duplicate_documents(spark, sf_dir):
    return validation.duplicate_documents(_source_pages(spark, sf_dir)).select(F.col("doc_order").alias("doc_id"), "same_as")


@register(f"""WITH h AS (SELECT doc_id, text, {_HASH} AS h FROM documents), m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM h), u AS (SELECT * FROM m WHERE first = doc_id)
  SELECT (SELECT count(*) FROM m) AS documents, (SELECT count(*) FROM m WHERE first <> doc_id) AS duplicate_documents, count(*) AS pages_processed, count(*) FILTER (length(text) < 80) AS near_empty_pages,
  count(*) FILTER (text = '') AS failed_pages, CAST(0 AS BIGINT) AS duplicate_pages_removed, count(*) FILTER (length(text) >= 80) AS pages_kept, count(*) FILTER (length(text) < 80) AS empty_documents FROM u""")
def ingest_report(spark, sf_dir):
    return validation.ingest(_source_pages(spark, sf_dir))[1]


_PAGED_CHECK = _LINES + f""", dh AS (SELECT doc_id, {_HASH} AS h FROM documents), du AS (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS first FROM dh),
pg AS (SELECT document_id, doc_id, page_number, text, {_HASH} AS h, length(text) < 80 AS short FROM pages JOIN du ON 'd' || doc_id = document_id WHERE first = doc_id),
st AS (SELECT *, CASE WHEN short THEN 'near_empty' WHEN doc_id * 1000000 + page_number = min(doc_id * 1000000 + page_number) FILTER (NOT short) OVER (PARTITION BY pg.h) THEN 'kept' ELSE 'duplicate' END AS status FROM pg)"""


def _numbered_pages(spark, sf_dir):
    return flat_pages(spark, sf_dir).withColumn("doc_order", F.substring("document_id", 2, 20).cast("long"))


@register(f"WITH {_PAGED_CHECK} SELECT document_id, CAST(page_number AS INT) AS page_number, status FROM st")
def paged_status(spark, sf_dir):
    """Pages of documents of several pages: each earlier page anywhere may be the original of a later one."""
    return validation.ingest(_numbered_pages(spark, sf_dir))[0].select("document_id", F.col("page_number").cast("int").alias("page_number"), "status")


@register(f"""WITH {_PAGED_CHECK} SELECT (SELECT count(*) FROM du) AS documents, (SELECT count(*) FROM du WHERE first <> doc_id) AS duplicate_documents, count(*) AS pages_processed, count(*) FILTER (status = 'near_empty') AS near_empty_pages,
  count(*) FILTER (text = '') AS failed_pages, count(*) FILTER (status = 'duplicate') AS duplicate_pages_removed, count(*) FILTER (status = 'kept') AS pages_kept, count(DISTINCT doc_id) - count(DISTINCT doc_id) FILTER (status = 'kept') AS empty_documents FROM st""")
def paged_report(spark, sf_dir):
    return validation.ingest(_numbered_pages(spark, sf_dir))[1]


# ---- chunking


_UNITS = _LINES + f""", paras AS (SELECT document_id, n, n // 6 + 1 AS page, {_STRIP.format(t='line')} AS text FROM lines WHERE {_STRIP.format(t='line')} <> ''),
m AS (SELECT p.*, CASE WHEN g.page_number % 2 = 1 AND starts_with(p.text, {_STRIP.format(t='g.first_line')}) THEN {_STRIP.format(t='g.first_line')} END AS hit FROM paras p JOIN pages g ON g.document_id = p.document_id AND g.page_number = p.page),
f AS (SELECT document_id, first_line FROM pages WHERE page_number = 1),
units AS (SELECT m.document_id, row_number() OVER (PARTITION BY m.document_id ORDER BY n) - 1 AS ord, m.text, page,
  coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY m.document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f.first_line) AS section FROM m JOIN f USING (document_id))"""


@register(f"WITH {_UNITS} SELECT document_id, CAST(ord AS INT) AS ord, md5(text) AS digest, CAST(page AS INT) AS page, section, CAST(len({_WS.format(t='text')}) AS INT) AS tokens FROM units")
def units(spark, sf_dir):
    return chunking.units(paged(spark, sf_dir)).select("document_id", "ord", F.md5(F.col("text").cast("binary")).alias("digest"), "page", "section", "tokens")


@register(
    f"""WITH {_UNITS}, w AS (SELECT document_id, ord, page, section, unnest(x) AS word, generate_subscripts(x, 1) AS k FROM (SELECT *, {_WS.format(t='text')} AS x FROM units)),
  g AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord, k) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS total FROM w),
  c AS (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((i - 63) / 56.0)) AS BIGINT), i // 56)) AS pos FROM g)
  SELECT document_id, document_id || ':fixed:' || lpad(CAST(pos AS VARCHAR), 5, '0') AS chunk_id, CAST(pos AS INT) AS position, md5(string_agg(word, ' ' ORDER BY i)) AS digest,
    min_by(section, i) AS section, CAST(min_by(page, i) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end, CAST(count(*) AS INT) AS token_count
  FROM c WHERE pos = 0 OR (pos - 1) * 56 + 64 < total GROUP BY document_id, pos"""
)
def fixed_chunks(spark, sf_dir):
    out = chunking.chunk(paged(spark, sf_dir), "fixed", chunking.Sizes(64, 8, 32))
    return out.select("document_id", "chunk_id", "position", F.md5(F.col("text").cast("binary")).alias("digest"), "section", "page_start", "page_end", "token_count")


@register("""WITH c AS (SELECT source AS document_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
  SELECT source AS document_id, count(*) AS chunks, max(n_chars) AS pages, min_by(lang, doc_id) AS title FROM documents GROUP BY 1""")
def corpus_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return stores.documents(d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("position"), F.col("n_chars").alias("page_end"), F.col("lang").alias("title"))).withColumnRenamed("pages", "pages")


@register("""SELECT a.conv_id || ':' || a.turn AS chunk_id, b.conv_id || ':' || b.turn AS neighbour_id, CAST(b.turn - a.turn AS INT) AS offset_ FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(b.turn - a.turn) <= 1""")
def neighbours(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("position"))
    return chunking.neighbours(c, c.select("chunk_id"), 1).withColumnRenamed("offset", "offset_")


# ---- sparse retrieval


def bm25_sql(docs: str, id_: str, queries: str = "benchmark", query_id: str = "item_id") -> str:
    """scored(query_id, id, score) of docs(id_, text) and queries(query_id, text), and what it is made of."""
    return f"""
d AS (SELECT {id_} AS id, {tok('text')} AS toks FROM {docs}), n AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
tf AS (SELECT id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT {query_id} AS query_id, unnest({tok('text')}) AS term FROM {queries}) GROUP BY ALL),
scored AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), n GROUP BY ALL)"""


_BM25 = bm25_sql("documents", "doc_id")


def hashed_sql(name: str, src: str, id_: str) -> str:
    """name(id, idx, value): the hashing embedding of src(id_, text)."""
    return f"""{name}_g AS (SELECT id, md5(unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]))) AS h FROM (SELECT {id_} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {src})),
{name}_s AS (SELECT id, (((CAST('0x' || substr(h, 1, 16) AS UBIGINT) % 384) * 256 + CAST('0x' || substr(h, 17, 16) AS UBIGINT) % 384) % 384) AS idx, sum(CASE WHEN CAST('0x' || substr(h, 16, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM {name}_g GROUP BY ALL HAVING v <> 0),
{name} AS (SELECT id, CAST(idx AS INT) AS idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM {name}_s)"""


def _top(k: int, frm: str = "scored", where: str = "score > 0") -> str:
    return f"(SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM {frm} WHERE {where} QUALIFY rank <= {k})"


_made: dict[tuple, tuple] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """An index or a table that several queries read, made once for a session and a folder of tables; made anew when the
    documents have changed or a table that it stands on is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    changed = tables.modified(spark, f"{sf_dir}/documents.parquet")
    found = _made.get(key)
    if found and found[1] == changed and all(tables.modified(spark, p) is not None for p in found[2]):
        return found[0]
    before = len(tables.WRITTEN)
    made = make()
    _made[key] = (made, changed, tables.WRITTEN[before:])
    return made


def _index(spark, sf_dir):
    return once(spark, sf_dir, "index", lambda: sparse.build(table(spark, sf_dir, "documents").withColumns(_meta()), "doc_id", F.col("text"), meta=True))


@register(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register(f"WITH {_BM25} SELECT * FROM {_top(10)}")
def bm25_topk(spark, sf_dir):
    return sparse.search(_index(spark, sf_dir), _bench(spark, sf_dir), 10)


def _meta() -> dict[str, Column]:
    """Documents' stand-in metadata."""
    date = F.when(F.col("doc_id") % 10 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")))
    return {"authority": F.col("source"), "document_type": F.col("lang"), "document_id": F.col("doc_id").cast("string"), "publication_date": date}


def _filters(spark, sf_dir):
    """(query_id, filter): filters that follow from the query's number."""
    some = lambda cond, v: F.when(cond, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    i = F.col("query_id")
    return _bench(spark, sf_dir).select("query_id", F.struct(some(i % 3 == 0, "src0").alias("authority"), some(i % 2 == 0, "en").alias("document_type"), F.array().cast("array<string>").alias("document_id"), F.when(i % 4 == 0, F.lit("2020-06-01").cast("date")).alias("gte"), F.lit(None).cast("date").alias("lte")).alias("filter"))


_PASS = """(query_id % 3 <> 0 OR source = 'src0') AND (query_id % 2 <> 0 OR lang = 'en') AND (query_id % 4 <> 0 OR doc_id % 10 = 0 OR DATE '2020-01-01' + CAST(doc_id % 1000 AS INT) >= DATE '2020-06-01')"""


@register(f"WITH {_BM25}, f AS (SELECT s.* FROM scored s JOIN documents ON doc_id = id WHERE {_PASS}) SELECT * FROM {_top(10, 'f')}")
def bm25_filtered(spark, sf_dir):
    """A filter leaves scores as they are.  Documents are judged in the scan that scores them, so that no pair of a query and a document is
    kept or shuffled but the best of each task."""
    return sparse.search(_index(spark, sf_dir), _bench(spark, sf_dir).join(_filters(spark, sf_dir), "query_id"), 10)


@register(f"""WITH {_BM25}, h AS (SELECT * FROM {_top(20)}), t AS (SELECT h.query_id, h.rank, h.id, round(len(list_intersect(list_distinct({tok('b.text')}), list_distinct({tok('d.text')}))) / greatest(len(list_distinct({tok('b.text')})), 1), 6) AS score
  FROM h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INT) AS rank, id, score FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 6""")
def lexical_rerank(spark, sf_dir):
    hits = sparse.search(_index(spark, sf_dir), _bench(spark, sf_dir), 20).drop("score")
    terms = _index(spark, sf_dir).tokens.select("id", "toks")
    return fusion.overlap_rerank(terms.join(broadcast_if_small(hits), "id"), _bench(spark, sf_dir), 6).select("query_id", "rank", "id", "score")


_SH = r"list_distinct(list_transform(generate_series(1, greatest(1, len({w}) - 4)), lambda i: array_to_string(list_slice({w}, i, i + 4), ' ')))"
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@register(f"""WITH {_BM25}, h AS (SELECT * FROM {_top(10)}), s AS (SELECT query_id, rank, {_SH.format(w='w')} AS s FROM (SELECT query_id, rank, {_W} AS w FROM h JOIN documents ON doc_id = id))
  SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON a.query_id = b.query_id AND a.rank < b.rank""")
def hit_similarity(spark, sf_dir):
    hits = sparse.search(_index(spark, sf_dir), _bench(spark, sf_dir), 10)
    return fusion.pair_similarity(hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id"))


def _hit_rows(spark, sf_dir, k: int = 20):
    hits = sparse.search(_index(spark, sf_dir), _bench(spark, sf_dir), k)
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("document_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(None).cast("string").alias("section"), F.col("lang").alias("title"),
        F.col("source").alias("authority"), F.lit(None).cast("date").alias("publication_date"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("parent_text"),
    )
    return hits.join(d, "id").withColumn("id", F.col("id").cast("string"))


_CW = "list_distinct(regexp_extract_all(lower({t}), '[a-z]{{4,}}'))"


@register(f"""WITH {_BM25}, h AS (SELECT * FROM {_top(8)}), s AS (SELECT h.query_id, rank, id, d.text, round(len(list_intersect({_CW.format(t='b.text')}, {_CW.format(t='d.text')})) / greatest(len({_CW.format(t='b.text')}), 1), 6) AS share
    FROM h JOIN documents d ON doc_id = id JOIN benchmark b ON item_id = query_id), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, rank) = 1)
  SELECT item_id AS query_id, CASE WHEN share >= 0.3 THEN CAST(id AS VARCHAR) END AS cited, coalesce(share < 0.3, true) AS insufficient FROM benchmark LEFT JOIN best ON query_id = item_id""")
def extractive_answers(spark, sf_dir):
    return grounding.extractive_answers(_hit_rows(spark, sf_dir, 8), _bench(spark, sf_dir)).select("query_id", "cited", "insufficient")


@register("""SELECT doc_id, '[chunk_id: ' || doc_id || '] ' || source || ' — ' || lang || ' | §' || source || ' | pp.1-2 | None' AS header, '[' || source || ' — ' || lang || ', §' || source || ', pp.1-2]' AS label FROM documents""")
def evidence_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("authority"), F.col("lang").alias("title"), F.col("source").alias("section"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit(None).cast("date").alias("publication_date"))
    return d.select("doc_id", ctx.header().alias("header"), grounding.label().alias("label"))


_CITED = f"""WITH {_BM25}, h AS (SELECT * FROM {_top(5)}), c AS (SELECT item_id AS query_id, unnest([CAST(item_id AS VARCHAR), 'missing'] || coalesce(ids, [])) AS id, generate_subscripts([CAST(item_id AS VARCHAR), 'missing'] || coalesce(ids, []), 1) - 1 AS ord
    FROM benchmark LEFT JOIN (SELECT query_id, list(CAST(id AS VARCHAR) ORDER BY rank) AS ids FROM h WHERE rank <= 3 GROUP BY 1) ON query_id = item_id),
  f AS (SELECT query_id, id, min(ord) AS ord FROM c GROUP BY ALL), k AS (SELECT f.*, EXISTS (SELECT 1 FROM h WHERE h.query_id = f.query_id AND CAST(h.id AS VARCHAR) = f.id) AS valid FROM f)"""


def _citations(spark, sf_dir):
    """Answers that cite their three best hits, their own number and an id that doesn't exist."""
    hits = sparse.search(_index(spark, sf_dir), _bench(spark, sf_dir), 5).withColumn("id", F.col("id").cast("string"))
    best = hits.where("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    own = F.array(F.col("query_id").cast("string"), F.lit("missing"))
    answers = _bench(spark, sf_dir).join(best, "query_id", "left").select("query_id", F.concat(own, F.coalesce("ids", F.array().cast("array<string>"))).alias("citations"))
    return hits, grounding.check_citations(answers, hits, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")))


@register(f"{_CITED} SELECT query_id, CAST(ord AS INT) AS ord, id, valid FROM k")
def citation_check(spark, sf_dir):
    return _citations(spark, sf_dir)[1]


@register(f"""{_CITED} SELECT query_id, round(CASE WHEN query_id % 5 <> 0 THEN coalesce(count(*) FILTER (valid AND lang = 'en') / nullif(count(*) FILTER (valid), 0), 0.0) END, 6) AS citation_correctness,
  CASE WHEN query_id % 5 <> 0 THEN CAST(bool_or(valid AND coalesce(source = 'src0', false)) AS DOUBLE) END AS citation_completeness, round(count(*) FILTER (NOT valid) / count(*), 6) AS invalid_citation_rate
  FROM k LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = id GROUP BY 1""")
def citation_metrics(spark, sf_dir):
    """Relevant: English; wanted document: src0; every fifth item is unanswerable."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("document_id"), (F.col("lang") == "en").alias("relevant"))
    cited = _citations(spark, sf_dir)[1].join(d, "id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    items = _bench(spark, sf_dir).select("query_id", (F.col("query_id") % 5 != 0).alias("answerable"), F.array(F.lit("src0")).alias("documents"))
    return metrics.citation_metrics(cited, items)


# ---- dense retrieval and fusion: every vector whose id is divisible by 20 is a query


def _vectors(spark, sf_dir, column: str = "embedding"):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr(column).alias("vector"), F.col("label").cast("string").alias("label"))
    return v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id")


_DENSE = """scored AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score, q.label = v.label AS same FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
half AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(v.embedding[1:32] AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""
_LISTS = f"WITH {_DENSE}, a AS (SELECT * FROM {_top(20, where='true')}), b AS (SELECT * FROM {_top(20, 'half', 'true')}), l AS (SELECT query_id, 0 AS list_no, rank, id, 'dense' AS r FROM a UNION ALL SELECT query_id, 1, rank, id, 'half' FROM b)"


@register(f"WITH {_DENSE} SELECT * FROM {_top(10, where='true')}")
def dense_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return dense.search(v, q, 10)


@register(f"WITH {_DENSE} SELECT * FROM {_top(10, where='same')}")
def dense_filtered(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return dense.search(v, q, 10, group="label")


def _two_lists(spark, sf_dir):
    (v, q), (v2, q2) = _vectors(spark, sf_dir), _vectors(spark, sf_dir, "slice(embedding, 1, 32)")
    return retrieval.as_list(dense.search(v, q, 20), 0, "dense").union(retrieval.as_list(dense.search(v2, q2, 20), 1, "half"))


def _rrf_sql(w0: float, w1: float, k: int) -> str:
    return f"""{_LISTS}, f AS (SELECT query_id, id, round(sum(CASE list_no WHEN 0 THEN {w0} ELSE {w1} END / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen, array_to_string(list_sort(list_distinct(list(r))), '+') AS sources FROM l GROUP BY ALL)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INT) AS rank, id, score, sources FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) <= {k}"""


@register(_rrf_sql(1.0, 1.0, 20))
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(_two_lists(spark, sf_dir), 20)


@register(_rrf_sql(2.0, 1.0, 10))
def weighted_rrf(spark, sf_dir):
    return fusion.rrf(_two_lists(spark, sf_dir), 10, weights={0: 2.0, 1: 1.0})


@register(f"{_LISTS}, s AS (SELECT query_id, id, min(2 * rank + list_no) AS slot FROM l GROUP BY ALL) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY slot) AS INT) AS rank, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY slot) <= 10")
def interleave(spark, sf_dir):
    return fusion.interleave(_two_lists(spark, sf_dir), 10)


_MODES = f"WITH {_DENSE}, a AS (SELECT * FROM {_top(20, where='true')}), m AS (SELECT a.*, q.label = v.label AS same FROM a JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = a.id), r AS (SELECT * FROM {_top(20, where='same')})"
_BOOSTED = "row_number() OVER (PARTITION BY query_id ORDER BY rank - CASE WHEN same THEN 5 ELSE 0 END, rank)"


@register(f"{_MODES} SELECT query_id, CAST({_BOOSTED} AS INT) AS rank, id FROM m")
def boost(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    hits = dense.search(v, q, 20).join(v.select("id", "label"), "id").join(q.select("query_id", F.col("label").alias("wanted")), "query_id")
    return fusion.boost(hits, F.col("label") == F.col("wanted")).select("query_id", "rank", "id")


@register(f"""{_MODES}, l AS (SELECT query_id, 0 AS n, rank, id FROM r UNION ALL SELECT query_id, 1, rank, id FROM a), i AS (SELECT query_id, id, min(2 * rank + n) AS slot FROM l GROUP BY ALL),
  x AS (SELECT 'boost' AS mode, query_id, {_BOOSTED} AS rank, id FROM m UNION ALL SELECT 'restrict', query_id, rank, id FROM r UNION ALL SELECT 'restrict_with_fallback', query_id, row_number() OVER (PARTITION BY query_id ORDER BY slot), id FROM i)
  SELECT mode, query_id, CAST(rank AS INT) AS rank, id FROM x WHERE rank <= 8 AND query_id % 40 = 0 UNION ALL SELECT mode, query_id, rank, id FROM a, (SELECT unnest(['boost', 'restrict', 'restrict_with_fallback']) AS mode) WHERE rank <= 8 AND query_id % 40 <> 0""")
def filter_modes(spark, sf_dir):
    """Every second query has an inferred filter: its own label."""
    v, q = _vectors(spark, sf_dir)
    plain = dense.search(v, q, 20).join(v.select("id", "label"), "id").join(q.select("query_id", F.col("label").alias("wanted")), "query_id")
    inferred = F.col("query_id") % 40 == 0
    own = dense.search(v, q, 20, group="label").where(inferred)
    parts = [retrieval.filtered(mode, plain, own, F.col("label") == F.col("wanted"), inferred, 8).select(F.lit(mode).alias("mode"), "query_id", "rank", "id") for mode in ("boost", "restrict", "restrict_with_fallback")]
    return metrics.union_all(parts)


@register(f"WITH {hashed_sql('e', 'benchmark', 'item_id')} SELECT id, idx, round(value, 6) AS value FROM e")
def hashing_embedding(spark, sf_dir):
    return dense.hashed_features(table(spark, sf_dir, "benchmark"), "item_id", F.col("text")).withColumn("value", F.round("value", 6))


@register(f"WITH {hashed_sql('e', 'documents', 'doc_id')} SELECT id, idx, round(value, 6) AS value FROM e")
def document_embedding(spark, sf_dir):
    """Whole documents, as hashing_embedding has the queries."""
    return dense.hashed_features(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).withColumn("value", F.round("value", 6))


# ---- query processing

#: What benchmark items are asked with, so that they name acronyms, documents and authorities.
LITERAL_QUERIES = (
    "What does the EBA say about CDD?", "AMLD4 duties", "Directive (EU) 2015/849 Article 13(1)", "FATF Recommendation 10 on peps", "the european banking authority and the ECB",
    "remote  customer onboarding guidelines", "EDD and UBO for ML/TF", "recdd is no acronym", "ECBA is no authority", "AMLR", "nothing here", "kyc; KYC",
)
_LITERAL = "[" + ", ".join(f"'{q}'" for q in LITERAL_QUERIES) + "]"


def _named_sql(patterns: dict[str, str], t: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '(?i){p}') THEN '{n}' END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


_ACR = {v: r"(^|[^\w])" + k + r"($|[^\w])" for k, v in query.ACRONYMS.items()}


@register(
    rf"""WITH q AS (SELECT item_id AS query_id, trim(regexp_replace(text || ' ' || {_LITERAL}[item_id % {len(LITERAL_QUERIES)} + 1], '\s+', ' ', 'g')) AS t FROM benchmark),
  p AS (SELECT *, {_named_sql(_ACR, 't')} AS e, {_named_sql(query.DOCUMENTS, 't')} AS d, {_named_sql(query.AUTHORITIES, 't')} AS a FROM q)
  SELECT query_id, CASE WHEN len(e) = 0 THEN t ELSE t || ' (' || array_to_string(e, '; ') || ')' END AS normalised, array_to_string(d, ',') AS document_ids, CASE WHEN len(d) > 0 THEN '' ELSE array_to_string(a, ',') END AS authorities FROM p"""
)
def processed_queries(spark, sf_dir):
    from .config import load

    more = F.element_at(F.array(*map(F.lit, LITERAL_QUERIES)), (F.col("query_id") % len(LITERAL_QUERIES)).cast("int") + 1)
    out = retrieval.process(_bench(spark, sf_dir).select("query_id", F.concat_ws(" ", "text", more).alias("text")), load(env={}))
    joined = lambda c: F.coalesce(F.array_join(F.col("inferred")[c], ","), F.lit(""))
    return out.select("query_id", "normalised", joined("document_id").alias("document_ids"), joined("authority").alias("authorities"))


# ---- answers


@register(f"""SELECT conv_id, turn, CASE WHEN k < 3 THEN text ELSE '{grounding.INSUFFICIENT}' END AS answer, CASE k WHEN 0 THEN 'c' || conv_id || ',' || role WHEN 2 THEN 'c' || conv_id ELSE '' END AS citations, k = 1 OR k > 2 AS insufficient
  FROM (SELECT *, (conv_id + turn) % 8 AS k FROM conversations)""")
def parsed_answers(spark, sf_dir):
    """Turns as a model might put them: JSON, fenced JSON, JSON inside of prose, prose, and JSON of other kinds."""
    k, c = (F.col("conv_id") + F.col("turn")) % 8, F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    reply = lambda ids, flag: F.to_json(F.struct(F.col("text").alias("answer"), F.transform(F.array(*ids) if ids else F.array().cast("array<string>"), lambda x: F.struct(x.alias("chunk_id"))).alias("citations"), F.lit(flag).alias("insufficient_evidence")))
    raw = (
        F.when(k == 0, reply([c, F.col("role")], False)).when(k == 1, F.concat(F.lit("```json\n"), reply([], True), F.lit("\n```"))).when(k == 2, F.concat(F.lit("So: "), reply([c], False), F.lit(" indeed")))
        .when(k == 3, F.translate("text", "{}", "()")).when(k == 4, F.to_json(F.struct(F.col("turn").alias("answer")))).when(k == 5, F.to_json(F.struct(F.col("text").alias("answer"), F.col("role").alias("citations"))))
        .when(k == 6, F.to_json(F.struct(F.array(F.struct(c.alias("chunk_id"))).alias("citations")))).otherwise(F.lit(""))
    )
    out = table(spark, sf_dir, "conversations").withColumn("p", grounding.parse_answer(raw))
    return out.select("conv_id", "turn", F.col("p.answer").alias("answer"), F.array_join("p.citations", ",").alias("citations"), F.col("p.insufficient_evidence").alias("insufficient"))


@register(r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 20) AS l FROM conversations)
  SELECT conv_id, turn, round(CASE WHEN len(l) = 0 THEN 0.0 WHEN len(l) = 1 AND turn % 2 = 1 THEN 1.0 ELSE len(list_filter(l, lambda x: regexp_matches(x, '\[\d+\]'))) / len(l) END, 6) AS coverage FROM s""")
def citation_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(grounding.coverage(F.col("text"), F.col("turn") % 2), 6).alias("coverage"))


@register(f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 2 = 1 THEN '{grounding.INSUFFICIENT + grounding.WITHHELD.replace("'", "''")}' ELSE text END AS answer, turn % 2 = 0 OR (turn % 3 = 0 AND text <> '') AS insufficient FROM conversations""")
def withheld_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = grounding.withhold(F.col("text"), F.col("turn") % 2 == 0, F.col("turn") % 3)
    return c.select("conv_id", "turn", w["answer"].alias("answer"), w["insufficient"].alias("insufficient"))


# ---- metrics: a vector's relevant units are the other vectors of its label


_COVERED = f"""WITH {_DENSE}, h AS (SELECT * FROM {_top(10, where='query_id <> id')}), c AS (SELECT h.query_id, h.rank, h.id AS unit FROM h JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = h.id WHERE q.label = v.label),
n AS (SELECT q.vec_id AS query_id, q.label, count(*) - 1 AS n FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 GROUP BY ALL)"""
_M = ", ".join(f"round(coalesce(count(unit) FILTER (rank <= {k}), 0) / nullif(any_value(n), 0), 6) AS recall_{k}, round(count(unit) FILTER (rank <= {k}) / {k}, 6) AS precision_{k}, CAST(count(unit) FILTER (rank <= {k}) > 0 AS DOUBLE) AS hit_{k}" for k in metrics.KS)
_METRICS = f"""{_COVERED}, m AS (SELECT query_id, {_M}, round(coalesce(1 / min(rank), 0), 6) AS mrr,
  round(coalesce(sum(1 / log2(rank + 1)), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(10, any_value(n)) AS INT) + 1) t(i)), 6) AS ndcg_10 FROM n LEFT JOIN c USING (query_id) GROUP BY 1)"""


def _scored(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    hits = dense.search(v, q, 11).where("query_id <> id")
    hits = top_k(hits.drop("rank"), 10)
    same = hits.join(v.select("id", "label"), "id").join(q.select("query_id", F.col("label").alias("wanted")), "query_id").where("label = wanted")
    sizes = q.join(v.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("query_id", (F.col("n") - 1).alias("n_units"))
    return q, metrics.retrieval_metrics(same.select("query_id", "rank", F.col("id").alias("unit")), q, sizes)


@register(f"{_METRICS} SELECT * FROM m")
def retrieval_metrics(spark, sf_dir):
    return _scored(spark, sf_dir)[1]


_NAMES = [f"{m}_{k}" for k in metrics.KS for m in ("recall", "precision", "hit")] + ["mrr", "ndcg_10"]


@register(f"{_METRICS} SELECT CAST(n.label AS VARCHAR) AS label, {', '.join(f'round(avg({c}), 4) AS {c}' for c in _NAMES)}, count(*) AS n FROM m JOIN n USING (query_id) GROUP BY ROLLUP (n.label)")
def metrics_by_group(spark, sf_dir):
    q, scored = _scored(spark, sf_dir)
    return metrics.means(scored.join(q.select("query_id", "label"), "query_id"), _NAMES, ["label"])


@register("""WITH e AS (SELECT query_id, source AS document_id, page FROM (SELECT item_id AS query_id, item_id % 20 AS s, unnest([1, 3]) AS page FROM benchmark WHERE item_id % 2 = 0) JOIN (SELECT DISTINCT source FROM documents) ON source = 'src' || s
    UNION ALL SELECT item_id, source, NULL FROM benchmark JOIN (SELECT DISTINCT source FROM documents) ON source = 'src' || (item_id % 20) WHERE item_id % 2 = 1)
  SELECT query_id, document_id, CAST(page AS INT) AS page FROM e""")
def evidence_units(spark, sf_dir):
    """Even items name pages 1 and 3 of a source, odd ones the source only."""
    name = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    named = F.array(F.struct(name.alias("document_id"), F.array(F.lit(1), F.lit(3)).alias("pages")))
    items = _bench(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 2 == 0, named).otherwise(F.slice(named, 1, 0)).alias("evidence"), F.array(name).alias("documents"))
    return metrics.evidence_units(items)


@register("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
  p AS (SELECT DISTINCT event_type, n, q, least(greatest((n + 1) * q // 100, 1), greatest(n - 1, 1)) AS a FROM r, (VALUES (50), (95)) t(q)),
  v AS (SELECT p.event_type, p.n, q, CASE WHEN p.n = 1 THEN x.value ELSE (x.value * (100 - ((p.n + 1) * q - a * 100)) + y.value * ((p.n + 1) * q - a * 100)) / 100 END AS v FROM p JOIN r x ON x.event_type = p.event_type AND x.k = a LEFT JOIN r y ON y.event_type = p.event_type AND y.k = a + 1)
  SELECT event_type, n, round(max(v) FILTER (q = 50), 6) AS p50, round(max(v) FILTER (q = 95), 6) AS p95 FROM v GROUP BY ALL""")
def quantiles_exclusive(spark, sf_dir):
    return metrics.exact_quantiles(table(spark, sf_dir, "events"), "event_type", "value")


@register("""WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000), a AS (SELECT event_type, list_sort(list(value)) AS v FROM l GROUP BY 1)
  SELECT event_type, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INT) + 1] AS p50, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INT) + 1] AS p95 FROM a""")
def service_percentiles(spark, sf_dir):
    rows = metrics.latest(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).groupBy("event_type").agg(F.collect_list("value").alias("v"))
    return rows.select("event_type", metrics.service_percentile(F.col("v"), 0.5).alias("p50"), metrics.service_percentile(F.col("v"), 0.95).alias("p95"))


@register(f"""WITH p(role, i, o) AS (VALUES ('user', 0.15, 0.6)) SELECT conv_id, turn, round(coalesce((len({_WS.format(t='text')}) * i + 60 * o) / 1000000, 0.0), 9) AS cost FROM conversations LEFT JOIN p USING (role)""")
def request_cost(spark, sf_dir):
    prices = spark.createDataFrame([("user", 0.15, 0.6)], "role string, i double, o double")
    c = table(spark, sf_dir, "conversations").join(F.broadcast(prices), "role", "left")
    return c.select("conv_id", "turn", F.round(metrics.cost(tx.token_count(F.col("text")), F.lit(60), F.col("i"), F.col("o")), 9).alias("cost"))


@register("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN CAST(turn % 3 <> 0 AS DOUBLE) END AS answerable_success, CASE WHEN conv_id % 2 <> 0 THEN CAST(turn % 3 = 0 AS DOUBLE) END AS abstention_accuracy FROM conversations""")
def answerability(spark, sf_dir):
    a, b = metrics.answerability(F.col("conv_id") % 2 == 0, F.col("turn") % 3 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("answerable_success"), b.alias("abstention_accuracy"))


@register("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS requests, round(avg(value), 6) AS mean, max(value) AS worst FROM events GROUP BY ALL")
def trace_windows(spark, sf_dir):
    return traces.windowed(table(spark, sf_dir, "events"))
