import random

import corpus_pipeline as cp
from lodestone.llm import sentencepiece_codec as sp

from .conftest import frame, near_copies
from .test_decontam import brute as hits
from .test_exact_dedup import brute as copies
from .test_ngram_join import brute as links


def write(spark, tmp_path, texts, items):
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    texts = near_copies(90, 21, edits=4) + [(900, None), (901, "123 456"), (902, "")]
    items = [(1, " ".join(texts[0][1].split()[5:30])), (2, "nothing of this kind")]
    sf = write(spark, tmp_path, texts, items)
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    left = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    keep = copies(left)
    left = [(i, t) for i, t in left if keep[i][0] == i]
    near = links(left, 5, 80, 100)
    left = [(i, t) for i, t in left if near[i][1] == i]
    clean = [(i, t) for i, t in left if not (lambda n, h, _: h > 0 and 20 * h >= n)(*hits(t, items))]
    assert set(got) == {i for i, _ in clean} and len(clean) < len(left)
    lib = sp.vocabulary(sp.MODEL).lib
    for i, t in clean:
        assert got[i].ids == lib.encode(t) and got[i].round_trip and got[i].n_pieces == len(got[i].ids)


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    sf = write(spark, tmp_path, [(1, "a")], [(1, "alpha beta")])
    for docs in (odd, none):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            rows = out.count()
            assert rows <= docs.count()
            if name == "exact_dedup" and docs is odd:
                assert rows == 7  # one of null, empty; one blank; alpha; the null id; two long ones; x
        assert cp.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(200))
    docs = frame(spark, [(7, text), (7, text), (3, text + " more"), (None, text + " x"), (9, "other words entirely here now then")])
    kept = cp.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [3, 9]
