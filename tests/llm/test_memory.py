"""Memory of the steps on text: what one slice takes, and what a worker keeps after a task."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from presswork.llm import common, kneser_ney, quality_rules, simhash_gray


def _texts(size):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(5000)]
    return [" ".join(rnd.choices(words, k=200)).encode() for _ in range(size // 1300)]


def _peak(fn):
    fn()
    tracemalloc.start()
    fn()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_hashes_of_a_slice_take_a_few_times_its_bytes():
    raw = _texts(3 << 20)
    assert _peak(lambda: kneser_ney.contexts(raw)) < 15 * sum(map(len, raw))


def test_fingerprints_of_a_slice_do_not_hold_the_bits_of_all_shingles():
    raw = _texts(1 << 20)
    assert _peak(lambda: simhash_gray.fingerprints(raw)) < 50 * sum(map(len, raw))


def test_fingerprints_do_not_depend_on_the_block(monkeypatch):
    raw = [*_texts(20_000), b"", b"one", b"one two", b" ", b"a b c d"]
    whole = simhash_gray.fingerprints(raw)
    for size in (1, 2, 300):
        monkeypatch.setattr(simhash_gray, "SHINGLES", size)
        assert simhash_gray.fingerprints(raw).tolist() == whole.tolist()


def test_a_worker_gives_back_what_a_task_freed(spark):
    def report(hold):
        def run(batches):
            import os

            from presswork.llm import common as here

            rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
            for _ in batches:
                blocks = [bytearray(60_000) for _ in range(3000 * hold)]
                now = rss()
                here.pinned = blocks[-1:]  # so the heap does not shrink by itself
                del blocks
                yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([now])], ["pid", "rss"])

        return common.map_arrow(spark.range(1).coalesce(1), run, "pid long, rss long").collect()[0]

    busy, idle = report(1), report(0)
    assert busy.pid != idle.pid or idle.rss < busy.rss - 100_000_000


def test_a_word_longer_than_a_block_has_the_same_hash(monkeypatch):
    raw = [b"ab " + b"xyz" * 500 + b" c", b"q" * 1000]
    want = common.word_hashes(common.Words(raw))
    monkeypatch.setattr(common, "PREFIX_BYTES", 100)
    assert np.array_equal(common.word_hashes(common.Words(raw)), want)


def test_plans_do_not_show_the_model(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    plan = quality_rules.keep_good(docs, labels)._jdf.queryExecution().toString()
    assert len(plan) < 100_000
