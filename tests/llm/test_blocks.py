import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from lodestone.llm import blocks as bl


class Sum(bl.Statistic):
    """Sums, of which a sender is told what the others add."""

    kind = out = np.dtype(np.int64)

    def combine(self, inverse, n, known):
        return np.bincount(inverse, weights=known, minlength=n).astype(np.int64)

    def answer(self, known):
        return np.zeros(len(known), np.int64)

    def settle(self, answers, known, own):
        return answers + known - own


@pytest.mark.parametrize("fan, range_bytes, levels", [(64, 1 << 24, 1), (8, 1 << 16, 2), (3, 1 << 16, 3)])
@pytest.mark.parametrize("bits", [40, 64])
def test_answers_come_back_in_the_order_of_the_keys(spark, fan, range_bytes, levels, bits):
    rng = np.random.default_rng(1)
    exchange = bl.Exchange(1 << 20, bits, fan, fan, range_bytes, block_bytes=1 << 15)
    assert len(exchange.fans) == levels and exchange.blocks == 32
    common = rng.integers(0, 1 << 62, 300).astype(np.uint64) << np.uint64(2)
    keys = {b: np.unique(np.concatenate((common[: 10 * b], rng.integers(0, 1 << 62, 50).astype(np.uint64))) >> np.uint64(64 - bits)) for b in range(31)} | {31: np.zeros(0, np.uint64)}
    known = {b: rng.integers(1, 9, len(k)) for b, k in keys.items()}
    total = {}
    for b, k in keys.items():
        for x, n in zip(k.tolist(), known[b].tolist()):
            total[x] = total.get(x, 0) + n

    def ask(table):
        b = table["id"][0].as_py()
        return pa.concat_tables([exchange.request(b, keys[b], known[b]), exchange.note(b, b"note %d" % b)])

    found = exchange.run(spark.range(32).groupBy("id").applyInArrow(ask, bl.REQUEST), Sum()).toArrow()
    for b, k in keys.items():
        mine = found.filter(pa.compute.equal(found["sender"], b))
        assert mine.filter(pa.compute.less(mine["bucket"], 0))["body"].to_pylist() == [b"note %d" % b]
        got = bl.answers(mine.filter(pa.compute.greater_equal(mine["bucket"], 0)), np.int64)
        assert got.tolist() == [total[x] - n for x, n in zip(k.tolist(), known[b].tolist())]


def test_rows_grow_with_the_text():
    """A block has a row for each of FAN ranges whatever the size; so has a merged run."""
    for gb in (0.1, 0.5, 30, 100_000):
        exchange = bl.Exchange(int(gb * 1e9), 64)
        assert exchange.fans[0] == bl.FAN and max(exchange.fans) <= bl.FAN
        assert exchange.ranges(len(exchange.fans)) * bl.RANGE_BYTES >= gb * 1e9
        assert exchange.blocks * bl.FAN / gb < 62_000
