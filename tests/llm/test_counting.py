"""Memory of the counts: what a worker holds beside its keys, and how much it sends at once."""

import tracemalloc
from collections import Counter, namedtuple

import numpy as np

from larkspur.llm import counting, ngram_join, store

Row = namedtuple("Row", "file sub once more times")


def test_packed_rows_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(counting, "BATCH_BYTES", 10_000)
    parts, rng = store.Parts(64, 1), np.random.default_rng(1)
    keys = [rng.integers(0, 1 << 64, 2_000, dtype=np.uint64) for _ in range(10)]
    keys += keys[:3]
    want = Counter(np.concatenate(keys).tolist())
    got = list(counting.pack(keys, parts.files_in))
    sent = [sum(len(x) for c in ("once", "more", "times") for x in pdf[c]) for pdf in got]
    assert len(got) > 5 and max(sent) < 2 * 10_000
    found, counts = counting.merge([r for pdf in got for r in pdf.itertuples(index=False)])
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == want and (np.diff(found.astype(object)) > 0).all()


def test_merge_holds_few_copies_of_its_keys():
    rng = np.random.default_rng(2)
    pool, want, rows = rng.integers(0, 1 << 64, 300_000, dtype=np.uint64), Counter(), []
    tracemalloc.start()
    for _ in range(20):
        own = np.unique(rng.choice(pool, 50_000))
        times = rng.integers(1, 4, len(own))
        want.update(dict(zip(own.tolist(), times.tolist(), strict=True)))
        rows.append(Row(0, 0, own[times == 1].tobytes(), own[times > 1].tobytes(), times[times > 1].astype("<u4").tobytes()))
    size = sum(len(r.once) + len(r.more) for r in rows)
    want_keys = np.array(sorted(want), "<u8")
    want_counts = np.array([want[k] for k in want_keys.tolist()])
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    keys, counts = counting.merge(rows)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert np.array_equal(keys, want_keys) and np.array_equal(counts, want_counts)
    assert peak < 3.5 * size, peak / size


def test_sets_of_a_large_batch_keep_their_ids(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 5000 - int(id)), x -> concat('w', x))) AS text").coalesce(1)
    folder, parts = f"file://{tmp_path}/ngrams", store.parts_for(1, 1)
    ngram_join.count_shared(docs, folder, parts, 4)
    found = ngram_join.sets(docs, folder, parts, 4, 85).selectExpr("doc_id", "n_shingles", "octet_length(tokens) AS bytes").collect()
    assert sum(r.bytes for r in found) > counting.BATCH_BYTES
    assert sorted((r.doc_id, r.n_shingles) for r in found) == [(i, 4997 - i) for i in range(300)]
