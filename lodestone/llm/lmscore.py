"""Cross-entropy difference scoring.

Two word-bigram models are counted over the whole corpus: the target model over the texts marked as
target, the background model over all others.  They are matched: same order, same smoothing, one shared
vocabulary (every word of either side).  p(w | v) interpolates the bigram share, the unigram share and a
uniform share over the shared vocabulary with the fixed weights BIGRAM and UNIGRAM.  A text's score is
the mean over its words of the target loss less the background loss (nats): the lower, the more it is
like the target.

A text that one side counted is scored with its own counts left out of that side, so that no text vouches for
itself, while copies of it elsewhere do.

Counts travel as in blocks.py: each block sends its distinct words and bigrams with its counts on either
side, and is answered the corpus counts.  Nothing is pruned, so what is gathered grows with the corpus.  Totals
and the vocabulary size are sums over the key ranges.

Defined results.  Null text and text without words: no words, score null.  Very long texts are handled
whole, by one task.  The first word of a text has no context and is scored by its unigram.  Rows that repeat
count each time, and equal texts of one side get equal scores.  A null id is never target.  Without target texts (or
without others, or where only the text itself is left out) the empty side is uniform over the vocabulary.  An empty
table gives an empty table; ties don't occur, as nothing is ranked.  Ids may be of any type that can be ordered.  Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import kernel as kn
from ..functions.sized import broadcast_if_small
from .sqltext import column
from .store import materialize

BIGRAM, UNIGRAM = 0.6, 0.35  # the rest is uniform
KEY_BITS = 56
PAIR = np.dtype([("target", "<u8"), ("background", "<u8")])
_WORD_TAG = np.uint64(1 << (KEY_BITS - 1))
RESULT = "key long, n_words long, target_loss double, background_loss double, score double"


class _Both(bl.Statistic):
    """Counts on either side."""

    kind = out = PAIR

    def combine(self, inverse, n, known):
        total = np.empty(n, PAIR)
        for side in PAIR.names:
            total[side] = np.bincount(inverse, weights=known[side], minlength=n)
        return total

    def answer(self, known):
        return known


class _Counts:
    """The words and bigrams of a block."""

    def __init__(self, table: pa.Table):
        data, offsets = kn.utf8(table["text"])
        self.w = kn.Words(data, offsets, kn.NOT_SPACE)
        n = len(self.w)
        drop = np.uint64(64 - KEY_BITS)
        # words and bigrams share one key space: the highest bit tells them apart
        self.words = (self.w.hashes >> drop) | _WORD_TAG
        self.at = np.flatnonzero(kn.inside(self.w.first, 2, n)) if n > 1 else np.zeros(0, np.int64)
        pairs = kn.grams(self.w.hashes, 2)[self.at] if n > 1 else np.zeros(0, np.uint64)
        self.pairs = (pairs >> drop) & ~_WORD_TAG
        self.keys, self.inverse = np.unique(np.concatenate((self.words, self.pairs)), return_inverse=True)
        self.owner = np.searchsorted(self.w.first, np.arange(n), side="right") - 1


def _own(counts: _Counts) -> np.ndarray:
    """How often the text of each word, and of each bigram, has it."""
    owner = np.concatenate((counts.owner, counts.owner[counts.at]))
    _, inverse, times = np.unique(owner * len(counts.keys) + counts.inverse, return_inverse=True, return_counts=True)
    return times[inverse]


class _Passes:
    def __init__(self, exchange: bl.Exchange):
        self.exchange = exchange

    def ask(self, table: pa.Table) -> pa.Table:
        c = _Counts(table)
        target = np.asarray(table["target"])
        mine = target[c.owner] if len(c.w) else np.zeros(0, bool)
        both = np.concatenate((mine, mine[c.at]))
        known = np.empty(len(c.keys), PAIR)
        for side, mask in zip(PAIR.names, (both, ~both)):
            known[side] = np.bincount(c.inverse[mask], minlength=len(c.keys))
        return self.exchange.request(table["block"][0].as_py(), c.keys, known)

    def score(self, table: pa.Table, replies: pa.Table, vocabulary: int, totals: tuple[int, int]) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("key", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64()))})
        c = _Counts(table)
        n = np.diff(c.w.first)
        losses = []
        if len(c.w):
            counts, own = bl.answers(replies, PAIR)[c.inverse], _own(c)
            target = np.asarray(table["target"])
            for name, total, on_side in zip(PAIR.names, totals, (target, ~target)):
                mine = on_side[c.owner]
                x = counts[name].astype(float) - own * np.concatenate((mine, mine[c.at]))
                one, two = x[: len(c.w)], x[len(c.w) :]
                rest = (total - n * on_side)[c.owner].astype(float)  # words of the side without the text's own
                base = UNIGRAM * np.where(rest > 0, one / np.maximum(rest, 1), 1 / vocabulary) + (1 - BIGRAM - UNIGRAM) / vocabulary
                p = base / (1 - BIGRAM)
                context = one[c.at]
                # a context that this side never saw leaves all weight to the unigram
                p[c.at + 1] = np.where(context > 0, base[c.at + 1] + BIGRAM * two / np.maximum(context, 1), p[c.at + 1])
                loss = np.zeros(len(n))  # each text's own sum, so that equal texts have equal losses
                loss[n > 0] = np.add.reduceat(-np.log(p), c.w.first[:-1][n > 0])
                losses.append(loss / np.maximum(n, 1))
        else:
            losses = [np.zeros(len(n))] * 2
        none = pa.array(n == 0)
        value = lambda x: pa.compute.if_else(none, pa.scalar(None, pa.float64()), pa.array(x))
        return pa.table({"key": table["key"], "n_words": pa.array(n.astype(np.int64)), "target_loss": value(losses[0]), "background_loss": value(losses[1]), "score": value(losses[0] - losses[1])})


def cross_entropy_difference(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", fan: int = bl.FAN, range_bytes: int = bl.RANGE_BYTES) -> DataFrame:
    """(key, n_words, target_loss, background_loss, score) of every row; target: rows with the ids of target texts."""
    exchange = bl.Exchange(bl.text_bytes(docs, text), KEY_BITS, fan, fan, range_bytes)
    passes = _Passes(exchange)
    wanted = target.select(column(key).alias("t")).where("t IS NOT NULL").distinct().withColumn("target", F.lit(True))
    marked = docs.select(column(key).alias("key"), column(text).alias("text")).join(broadcast_if_small(wanted), F.col("key") == F.col("t"), "left").select("key", "text", F.coalesce("target", F.lit(False)).alias("target"))

    def work(rows: DataFrame) -> DataFrame:
        texts = bl.dealt(rows, exchange.blocks, "target").groupBy("block")
        counts = materialize(exchange.run(texts.applyInArrow(bl.one(passes.ask), bl.REQUEST), _Both()), "counts")
        # words are the upper half of the key ranges, bigrams the lower one
        sums = counts.where(F.col("sums").isNotNull() & (F.col("bucket") >= exchange.ranges(len(exchange.fans)) // 2)).agg(*[F.sum(F.col("sums")[i]) for i in range(3)]).first()
        vocabulary, totals = max(1, sums[0] or 0), (sums[1] or 0, sums[2] or 0)
        return texts.cogroup(counts.where("sender >= 0").groupBy("sender")).applyInArrow(bl.two(lambda t, r: passes.score(t, r, vocabulary, totals)), RESULT)

    return bl.with_integer_ids(marked, "key", "text", work, ["key"], ("target",)).withColumnRenamed("key", key)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Losses to six digits, as sums of logarithms differ in the last ones with their order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    found = cross_entropy_difference(docs, good)
    return found.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def _loss_sql(side: str, own: str) -> str:
    """Loss of a token on a side whose columns are one (its word), ctx (the word before), two (the pair) and all (words)."""
    mine = lambda x: f"CASE WHEN {own} THEN {x} ELSE 0 END"
    rest = f"({side}_all - {mine('n')})"
    base = f"({UNIGRAM} * CASE WHEN {rest} > 0 THEN ({side}_one - {mine('own_one')}) / greatest({rest}, 1) ELSE 1 / v END + {round(1 - BIGRAM - UNIGRAM, 10)} / v)"
    ctx = f"({side}_ctx - {mine('own_ctx')})"
    return f"-ln(CASE WHEN prev IS NOT NULL AND {ctx} > 0 THEN {base} + {BIGRAM} * ({side}_two - {mine('own_two')}) / {ctx} ELSE {base} / {1 - BIGRAM} END)"


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS MATERIALIZED (SELECT doc_id, t, n, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM (SELECT *, len(w) AS n, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
one AS MATERIALIZED (SELECT word, count(*) FILTER (t) AS a, count(*) FILTER (NOT t) AS b FROM w GROUP BY 1),
two AS MATERIALIZED (SELECT prev, word, count(*) FILTER (t) AS a, count(*) FILTER (NOT t) AS b FROM w WHERE prev IS NOT NULL GROUP BY 1, 2),
own AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2), pairs AS MATERIALIZED (SELECT doc_id, prev, word, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT count(*) AS v, sum(a) AS a_all, sum(b) AS b_all FROM one),
x AS (SELECT w.*, v, a_all, b_all, one.a AS a_one, one.b AS b_one, c.a AS a_ctx, c.b AS b_ctx, two.a AS a_two, two.b AS b_two, o.n AS own_one, oc.n AS own_ctx, p.n AS own_two
  FROM w CROSS JOIN s JOIN one ON one.word = w.word JOIN own o ON o.doc_id = w.doc_id AND o.word = w.word LEFT JOIN one c ON c.word = w.prev LEFT JOIN own oc ON oc.doc_id = w.doc_id AND oc.word = w.prev
  LEFT JOIN two ON two.prev = w.prev AND two.word = w.word LEFT JOIN pairs p ON p.doc_id = w.doc_id AND p.prev = w.prev AND p.word = w.word),
l AS (SELECT doc_id, sum({_loss_sql('a', 't')}) / count(*) AS ta, sum({_loss_sql('b', 'NOT t')}) / count(*) AS ba FROM x GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(ta, 6) AS target_loss, round(ba, 6) AS background_loss, round(ta - ba, 6) AS score FROM d LEFT JOIN l USING (doc_id)
"""
