"""Jaccard self-join on word n-gram sets by rare-first prefix filtering.

1. The document frequency of every shingle is counted over the whole corpus (blocks.py), and each text
   orders its set from rare to frequent.  Two sets that reach the threshold share one of their first
   size - ceil(t * size) + 1 shingles; shingles of one text only are never sent.
2. Postings of those prefixes meet by shingle.  A pair must pass the length filter, the positional
   filter (what is left of both sets after the shared shingle can still reach the needed overlap) and,
   as suffix filter, a bound on the symmetric difference: the sets' 256-bit parity maps differ in no
   more bits than the sets do in members.
3. Each surviving pair is verified once: one set travels to the block of the other.

Equal sets are one node from the start, so copies are never expanded.  Lists of more than CHUNK
postings are first joined in chunks, whose links give components; then pairs of such a list that lie in
different components and are of similar size are joined.  So no link between components is lost, while a large
group of near copies doesn't emit all its pairs.  Texts of similar size that share a frequent shingle among their rarest, and
lie in different components, are compared with each other however many they are.

n_links is the number of pairs of rows in a component that reach the threshold, copies too.  Pairs of one
component are compared once more for it, all of them: its sets are dealt into chunks, each two chunks meet
in a tile, and a tile counts its links by matrix products and returns one number.  The work is quadratic in
the size of a component, the rows are not.

Defined results.  Texts without words (null, empty, blank) have an empty set, link with nothing and are
components of their own with 0 links.  Very long texts are handled whole, by one task.  Rows that repeat are one
node; a null key is in a component but never names one, and a component of null keys alone has a null id.  Ids
may be of any type that can be ordered.  An empty table gives an empty table.  Ties: a pair that is exactly
at the threshold links, and shingles of equal frequency are ordered by their hash, so that every text orders them alike.  Only the id
and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import kernel as kn
from .components import components
from .store import discard, materialize

FREQ_BITS = 40
CHUNK = 32
TILE_SETS, TILE_SHINGLES = 512, 1 << 20  # sets and their members in a chunk of a tile, about
COLUMNS = 4096  # shingles of a matrix product
STEPS = 8  # frequency classes for each doubling
POSTING = "shingle long, node long, size int, pos int, freq int, m0 long, m1 long, m2 long, m3 long, block long, key long"
PARCEL = "block long, node long, body binary, others array<bigint>"
LINK = "a long, b long"
MEMBER = "label long, chunk long, chunks long, copies long, body binary"
COUNT = "label long, links long"


class Sets:
    """The shingle sets of the texts of a block: distinct hashes, ordered by text and hash."""

    def __init__(self, table: pa.Table, n: int):
        data, offsets = kn.utf8(table["text"])
        w = kn.Words(data, offsets, kn.NOT_SPACE, kn.FOLD)
        words, texts = len(w), len(w.first) - 1
        g = kn.grams(w.hashes, n)
        at = np.flatnonzero(kn.inside(w.first, n, words))
        owner = np.searchsorted(w.first, at, side="right") - 1
        hashes = g[at]
        counts = np.diff(w.first)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = [int(kn.mix(np.array([len(x)], np.uint64) + kn.grams(x, len(x)))[0]) for x in (w.hashes[w.first[i] : w.first[i + 1]] for i in short)]
            hashes = np.concatenate((hashes, np.array(whole, np.uint64)))
            owner = np.concatenate((owner, short))
        order = np.argsort(hashes, kind="stable")
        order = order[np.argsort(owner[order].astype(np.uint16 if texts < 65536 else np.int64), kind="stable")]
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[fresh], owner[fresh]
        self.first = np.searchsorted(self.owner, np.arange(texts + 1))
        self.sizes = np.diff(self.first)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kn.mix(self.hashes ^ np.uint64(0xA5A5)), dtype=np.uint64)))
        self.nodes = kn.mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def get(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def maps(self) -> np.ndarray:
        """256 parity bits of each set, as 4 integers."""
        texts = len(self.sizes)
        bit = self.owner * 256 + (self.hashes & np.uint64(255)).astype(np.int64)
        odd = (np.bincount(bit, minlength=texts * 256) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(texts, 256), axis=1).view(np.int64).reshape(texts, 4)

    def distinct_nodes(self) -> np.ndarray:
        """One text of each node."""
        return np.unique(self.nodes, return_index=True)[1]


def _ceil_div(a, b):
    return -(-a // b)


def count_pairs(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, num: int, den: int) -> int:
    """Pairs of rows whose sets link: between the two sides, or among all sets if there is only one side."""
    cross = bool(side.any() and not side.all())
    x, y = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(sets)),) * 2
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles of one set only add to no pair
    of_column = np.cumsum(times > 1) - 1
    stay = times[column] > 1
    column, owner = of_column[column[stay]], owner[stay]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(x), len(y)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        m[owner[i:j], column[i:j] - start] = 1
        both += (m[x] @ m[y].T).astype(np.int64)
    link = den * both >= num * (sizes[x][:, None] + sizes[y] - both)
    if not cross:
        link = np.triu(link, 1)
    return int(copies[x] @ (link @ copies[y]))


class _Frequency(bl.Statistic):
    """Frequency classes, STEPS for each doubling; 0 where one text alone has the shingle.  known: the number of texts."""

    kind, out = np.dtype(np.uint32), np.dtype(np.uint8)

    def combine(self, inverse, n, known):
        return np.minimum(np.bincount(inverse, weights=known, minlength=n), 2**32 - 1).astype(np.uint32)

    def answer(self, known):
        return np.where(known > 1, np.minimum(255, 1 + STEPS * np.log2(np.maximum(known, 1))), 0).astype(np.uint8)


class _Passes:
    def __init__(self, exchange: bl.Exchange, n: int, num: int, den: int):
        self.exchange, self.n, self.num, self.den = exchange, n, num, den

    def _own(self, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        """Members of one text of each node, and their frequency keys."""
        stay = np.zeros(len(sets.sizes), bool)
        stay[sets.distinct_nodes()] = True
        mine = stay[sets.owner]
        return mine, sets.hashes[mine] >> np.uint64(64 - FREQ_BITS)

    def ask(self, table: pa.Table) -> pa.Table:
        _, keys = self._own(Sets(table, self.n))
        distinct, counts = np.unique(keys, return_counts=True)
        return self.exchange.request(table["block"][0].as_py(), distinct, counts.astype(np.uint32))

    def postings(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        sets = Sets(table, self.n)
        texts = len(sets.sizes)
        mine, keys = self._own(sets)
        _, inverse = np.unique(keys, return_inverse=True)
        freq = bl.answers(replies, np.uint8)[inverse] if len(keys) else np.zeros(0, np.uint8)
        hashes, owner = sets.hashes[mine], sets.owner[mine]
        # stable: members stay ordered by hash within a frequency class
        order = np.argsort(freq, kind="stable")
        order = order[np.argsort(owner[order].astype(np.uint16 if texts < 65536 else np.int64), kind="stable")]
        hashes, owner, freq = hashes[order], owner[order], freq[order]
        pos = np.arange(len(owner)) - np.searchsorted(owner, owner)
        size = sets.sizes[owner]
        prefix = size - _ceil_div(self.num * size, self.den) + 1
        send = (pos < prefix) & (freq > 0)
        maps = sets.maps()
        owner = owner[send]
        block = table["block"][0].as_py() if table.num_rows else 0
        k = len(owner)
        rows = {
            "shingle": pa.concat_arrays([pa.array(hashes[send].view(np.int64)), pa.nulls(texts, pa.int64())]),
            "node": np.concatenate((sets.nodes[owner], sets.nodes)),
            "size": np.concatenate((sets.sizes[owner], sets.sizes)).astype(np.int32),
            "pos": np.concatenate((pos[send], np.zeros(texts))).astype(np.int32),
            "freq": np.concatenate((freq[send], np.zeros(texts))).astype(np.int32),
            **{f"m{i}": np.concatenate((maps[owner, i], np.zeros(texts, np.int64))) for i in range(4)},
            "block": np.full(k + texts, block, np.int64),
            "key": pa.concat_arrays([pa.nulls(k, pa.int64()), table["key"].combine_chunks() if texts else pa.array([], pa.int64())]),
        }
        return pa.table({c: pa.array(v) for c, v in rows.items()})

    def send(self, table: pa.Table, pairs: pa.Table) -> pa.Table:
        """The set of each pair's first node, for the block of the other."""
        out: dict[tuple[int, int], list[int]] = {}
        for a, b, to in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), pairs["to"].to_pylist()):
            out.setdefault((to, a), []).append(b)
        sets = Sets(table, self.n)
        at = {int(x): i for i, x in enumerate(sets.nodes)}
        body = {a: bl.squeeze(np.diff(sets.get(at[a]), prepend=np.uint64(0))) for a in {a for _, a in out}}
        return pa.table(
            {"block": pa.array([to for to, _ in out], pa.int64()), "node": pa.array([a for _, a in out], pa.int64()), "body": pa.array([body[a] for _, a in out], pa.binary()), "others": pa.array(list(out.values()), pa.list_(pa.int64()))}
        )

    def verify(self, table: pa.Table, parcels: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if parcels.num_rows:
            sets = Sets(table, self.n)
            at = {int(x): i for i, x in enumerate(sets.nodes)}
            for a, body, others in zip(parcels["node"].to_pylist(), parcels["body"], parcels["others"].to_pylist()):
                x = np.cumsum(bl.unsqueeze(body.as_py(), np.uint64), dtype=np.uint64)
                for b in others:
                    y = sets.get(at[b])
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int(np.count_nonzero(large[where] == small))
                    if self.den * both >= self.num * (len(x) + len(y) - both):
                        links.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    def bodies(self, table: pa.Table, members: pa.Table) -> pa.Table:
        """The sets of the members of components."""
        sets = Sets(table, self.n) if members.num_rows else None
        at = {int(x): i for i, x in enumerate(sets.nodes)} if sets else {}
        body = [bl.squeeze(np.diff(sets.get(at[a]), prepend=np.uint64(0))) for a in members["node"].to_pylist()]
        return pa.table({**{c: members[c] for c in ("label", "chunk", "chunks", "copies")}, "body": pa.array(body, pa.binary())})

    def tile(self, table: pa.Table) -> pa.Table:
        """The links of each label of a tile: between its two chunks, or inside the only one."""
        label, chunk, copies = (table[c].to_numpy() for c in ("label", "chunk", "copies"))
        body = table["body"].combine_chunks()
        order = np.argsort(label, kind="stable")
        names, first = np.unique(label[order], return_index=True)
        links = []
        for at in np.split(order, first[1:]):
            sets = [np.cumsum(bl.unsqueeze(body[int(i)].as_py(), np.uint64), dtype=np.uint64) for i in at]
            # a tile of two chunks of which one got no set has no pairs
            alone = table["i"][0].as_py() != table["j"][0].as_py() and len(set(chunk[at].tolist())) == 1
            links.append(0 if alone else count_pairs(sets, copies[at], chunk[at] != chunk[at[0]], self.num, self.den))
        return pa.table({"label": pa.array(names, pa.int64()), "links": pa.array(links, pa.int64())})


def _candidates(x: DataFrame, on: list[str], num: int, den: int, apart: bool = False) -> DataFrame:
    """Pairs of postings that pass the filters, once each; a sits in block and b in to.

    apart, for long lists: only pairs of different labels, and the length filter is part of the join: sizes fall into classes
    of the ratio den / num, so two sets that can link are of one class or of neighbouring ones, and no other pairs are made.
    """
    columns = ["node", "size", "pos", "m0", "m1", "m2", "m3", "block", *(["label"] if apart else [])]
    once = "a_node < b_node"
    a = b = x
    if apart:
        x = x.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / math.log(den / num)).cast("int"))
        # a meets its own class and the one above it; a size on an edge may be taken for the class below, hence the second step
        a, b = x.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("class", F.col("class") + F.col("step")), x.withColumn("step", F.lit(0))
        on, columns = [*on, "class"], [*columns, "step"]
        once = "(a_step > 0 OR a_node < b_node)"
    a = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns])
    need = f"CAST(CEIL(CAST({num} * (a_size + b_size) AS DOUBLE) / {num + den}) AS INT)"
    test = [
        once,
        f"{den} * least(a_size, b_size) >= {num} * greatest(a_size, b_size)",
        f"least(a_size - a_pos, b_size - b_pos) >= {need}",
        f"bit_count(a_m0 ^ b_m0) + bit_count(a_m1 ^ b_m1) + bit_count(a_m2 ^ b_m2) + bit_count(a_m3 ^ b_m3) <= a_size + b_size - 2 * {need}",
        *(["a_label <> b_label"] if apart else []),
    ]
    both = a.join(b, [a[c] == b[c] for c in on] + [F.expr(" AND ".join(test))])
    return both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_block").alias("block"), F.col("b_block").alias("to")).distinct()


def ngram_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100, count_links: bool = True, fan: int = bl.FAN, range_bytes: int = bl.RANGE_BYTES
) -> DataFrame:
    """(key, n_shingles, component_id[, n_links]) of every row; sets link when den * |x & y| >= num * |x | y|."""
    passes = _Passes(bl.Exchange(bl.text_bytes(docs, text), FREQ_BITS, fan, fan, range_bytes), n, num, den)
    out = bl.with_integer_ids(docs, key, text, lambda rows: _joined(rows, passes, count_links), ["key", "component_id"])
    return out.withColumnRenamed("key", key)


def _joined(docs: DataFrame, passes: _Passes, count_links: bool) -> DataFrame:
    num, den, nb = passes.num, passes.den, passes.exchange.blocks
    texts = bl.dealt(docs, nb)
    by_block = lambda df: df.groupBy("block")
    freq = passes.exchange.run(by_block(texts).applyInArrow(bl.one(passes.ask), bl.REQUEST), _Frequency())
    sent = materialize(by_block(texts).cogroup(freq.groupBy("sender")).applyInArrow(bl.two(passes.postings), POSTING), "postings")
    rows = sent.where("shingle IS NULL").select("key", "node", "size", "block")
    # Copies in several blocks send the same postings.
    lists = sent.where("shingle IS NOT NULL").groupBy("shingle", "node", "size", "pos", "freq", "m0", "m1", "m2", "m3").agg(F.min("block").alias("block"))
    chunks = F.ceil(F.pow(F.lit(2.0), (F.col("freq") - 1) / STEPS) / CHUNK)
    # Written, here and below, so that the joins by shingle deal both sides anew and can split a long list over tasks.
    lists = materialize(lists.withColumn("chunk", F.pmod(F.xxhash64("node", "shingle"), chunks.cast("long"))), "lists")
    rows = materialize(rows, "sets")
    discard(sent)

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        # only blocks with pairs have to be read again
        both = bl.only(texts, pairs.select("block").union(pairs.select(F.col("to").alias("block"))))
        parcels = by_block(both).cogroup(by_block(pairs)).applyInArrow(bl.two(passes.send), PARCEL)
        return materialize(by_block(both).cogroup(by_block(parcels)).applyInArrow(bl.two(passes.verify), LINK), label)

    pairs = materialize(_candidates(lists, ["shingle", "chunk"], num, den), "pairs")
    links = linked(pairs, "links")
    labels = components(links)
    # Lists that were joined in chunks: the pairs of different components.
    long = lists.where(chunks > 1).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = long.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle")
    long = materialize(long.join(mixed, "shingle", "left_semi"), "lists")
    rest = materialize(_candidates(long, ["shingle"], num, den, apart=True), "pairs")
    if rest.limit(1).count():
        more = linked(rest, "links")
        if more.limit(1).count():
            labels = components(links.union(more))
    discard(pairs, rest, lists, long)

    of_node = rows.where("size > 0").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.min("block").alias("block"), F.max("size").cast("long").alias("members"))
    of_node = of_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = of_node.groupBy("label").agg(F.min("least").alias("component_id"), F.sum(F.expr("copies * (copies - 1) div 2")).alias("n_links"), F.count("*").alias("nodes"), F.sum("members").alias("members"))
    if count_links:
        of_node, of_label = materialize(of_node, "nodes"), materialize(of_label, "components")
        chunks = F.greatest(F.ceil(F.col("nodes") / TILE_SETS), F.ceil(F.col("members") / TILE_SHINGLES)).cast("long").alias("chunks")
        members = of_node.drop("members").join(of_label.where("nodes > 1").select("label", chunks), "label").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
        bodies = by_block(texts).cogroup(by_block(members)).applyInArrow(bl.two(passes.bodies), MEMBER)
        # components of one chunk share tiles
        met = bodies.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("whole", F.col("chunks") == 1)
        met = met.select("label", "chunk", "copies", "body", F.when(F.col("whole"), F.pmod(F.xxhash64("label"), F.lit(nb))).otherwise(F.col("label")).alias("tile"), *[F.when(F.col("whole"), -1).otherwise(f("chunk", "other")).alias(c) for f, c in ((F.least, "i"), (F.greatest, "j"))])
        counted = met.groupBy("tile", "i", "j").applyInArrow(bl.one(passes.tile), COUNT).groupBy("label").agg(F.sum("links").alias("links"))
        counted = materialize(counted, "counts")
        of_label = of_label.join(counted, "label", "left").withColumn("n_links", F.col("n_links") + F.coalesce("links", F.lit(0)))
    found = materialize(of_node.join(of_label.select("label", "component_id", "n_links"), "label").select("node", "component_id", "n_links"), "nodes")
    if count_links:
        discard(of_node, counted)
    size = F.col("size")
    out = ["key", size.cast("long").alias("n_shingles"), F.when(size > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")]
    return rows.join(found, "node", "left").select(*out, *([F.when(size > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links")] if count_links else []))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sets as strings, all pairs that share a shingle, and the smallest id that reaches each document.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.doc WHERE r.label < e.b),
c AS (SELECT doc, min(label) AS label FROM r GROUP BY 1),
k AS (SELECT label, count(*) AS k FROM l JOIN c ON doc = a GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.label AS component_id, coalesce(k.k, 0) AS n_links FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc = d.doc_id LEFT JOIN k ON k.label = c.label
"""
