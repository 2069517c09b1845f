"""Every operator against a plain version on a small table, and on odd and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, language_model, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, repeats, store, tokens, topk
from larkspur.llm.queries import QUERIES
from larkspur.llm.suffix_array import suffix_array

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


def near(a, b):
    return abs(a - b) < 1e-6 * (1 + abs(b))


# -- token counts ------------------------------------------------------------------------------------


def encoder():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_memo_equals_whole_texts(docs):
    odd = ["a's don't’s É ́x ΣΑΣ\x1cq \tz İ <|endoftext|>x\r\nfoo 12３ 中文　字 word.%%% x_y a... 'tis ²a a².", " ", None]
    texts, encode = [*odd, *[r.text for r in docs[:40]]], encoder()
    for limit in (0, 10, 100_000):
        found = tokens.WordMemo(tokens.vocabulary_path(), limit).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [encode(t) for t in texts]


def test_memo_of_every_latin_letter():
    marks = [chr(c) for c in range(0x260)] + list("\u0301\u0307\u0345\u03a3\u1e9e\u212a\u2c65\u1100\u1161\ufb01\uab5b\U00010d4a")
    texts, encode = [" ".join([c, f"a{c}b", f"{c}{c.upper()}z", f"the{c}", f"{c}'s."]) for c in marks], encoder()
    texts.append(" ".join(f"{a}{b}" for a in marks[0xAA:] for b in "xé\u0130"))
    for limit in (0, 100, 100_000):
        found = tokens.WordMemo(tokens.vocabulary_path(), limit).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [encode(t) for t in texts]


class Counted:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_memo_encodes_new_words_together():
    words = [f"{a}{b}{c}é" for a in "bcdfgh" for b in "aeiou" for c in "lmnrstvw"]
    texts, encode = [" ".join(words), " ".join(w.title() + "." for w in words)], encoder()
    for limit in (0, 100_000):
        memo = tokens.WordMemo(tokens.vocabulary_path(), limit)
        memo.tokenizer = counted = Counted(memo.tokenizer)
        assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode(texts)] == [encode(t) for t in texts]
        assert counted.given <= 2  # the mark, not each of the 240 words


def test_histogram(spark, docs):
    lengths = [len(encoder()(r.text)) for r in docs]
    histogram = QUERIES["op1_token_counts"](spark, SF)
    rows = histogram.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.docs_longer == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.n_tokens)
    for r in tokens.at_limit(histogram, [0, 77, 10**6]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths)
        assert r.docs_fitting == sum(x <= r.context_limit for x in lengths)
    assert tokens.quantile(histogram, 0.5) == sorted(lengths)[len(lengths) // 2 - 1]


# -- packing -----------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity=packing.CAPACITY):
    encode, by_doc, by_sequence = encoder(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids, at = np.array([*encode(text), 2], dtype="<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing(spark, docs):
    rows = QUERIES["op3_packing"](spark, SF).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs})
    assert used <= 1.03 * sum(r.length for r in rows) / packing.CAPACITY + 1


def test_packing_plan_holds_everything():
    rng = random.Random(1)
    for _ in range(20):
        histogram = {s: rng.randint(1, 60) for s in rng.sample(range(1, 65), rng.randint(1, 20))}
        plan = packing.plan(histogram, 64)
        total = Counter()
        for counts, times in plan:
            assert sum(s * c for s, c in counts.items()) <= 64
            total.update({s: c * times for s, c in counts.items()})
        assert total == histogram


# -- top-k -------------------------------------------------------------------------------------------


def test_topk_with_ties_odd_vectors_and_wide_values(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.5, -0.25, 3.0, 1e-3, -700.0]) for _ in range(6)]) for i in range(150)]
    rows += [(150, None), (151, [1.0, None]), (152, [float("nan")]), (153, [float("inf")]), (154, [1.0]), (155, []), (156, rows[0][1]), (157, rows[0][1]), (50, rows[50][1]), (100, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    v = topk.quantised(df)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), block_rows=64).collect())
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for q, a in [x for x in usable if x[0] % 50 == 0]:  # a query a row: one id asked twice, another with two vectors
        scores = sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q), key=lambda s: (-s[0], s[1]))
        expected.update((q, k, i, s) for k, (s, i) in enumerate(scores[:5], 1))
    assert got == expected
    assert topk.top_k(v.limit(0), v).count() == 0


# -- line dedup --------------------------------------------------------------------------------------


def test_keep_bitmaps_hold_only_words_that_lose_lines(spark):
    line = "a line that is long enough to be a key of its own, number "
    long = [f"{i}" if i not in (3, 64, 700) else f"{line}{i}" for i in range(900)]
    rows = [(0, "\n".join(long))] + [(i, "\n".join(f"{line}{k}" for k in (3, 64, 700))) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r._id: {w["at"]: w["bits"] for w in r.keep} for r in line_dedup.keep_bitmaps(df).collect()}
    every = (1 << 64) - 1
    assert found[0] == {0: (every ^ 1 << 3) - (1 << 64), 1: (every ^ 1) - (1 << 64), 10: (every ^ 1 << 60) - (1 << 64)}
    assert 5 not in found
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert kept[0].text.split("\n") == [x for i, x in enumerate(long) if i not in (3, 64, 700)] and kept[0].n_dropped == 3


# -- repeats and suffix arrays -----------------------------------------------------------------------


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(300):
        top = rng.choice([1, 2, 5])
        s = np.array([rng.randint(1, top) for _ in range(rng.randint(1, 60))] + [0])
        assert list(suffix_array(s, top + 1)) == sorted(range(len(s)), key=lambda i: list(s[i:]))


def test_repeats(spark, docs):
    expected = brute.repeats([(r.doc_id, r.text) for r in docs])
    for r in QUERIES["op5_repeats"](spark, SF).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id]


def test_repeats_edited_periodic_and_long(spark, monkeypatch):
    rng = random.Random(4)
    base = bytes(rng.choice(b"abc \0") for _ in range(2500)).decode()
    texts = [base, base[100:700] + "é" + base[705:1500], "ab" * 400, "ab" * 400 + base[40:139], "z" * 99, base[:100], None, "", base[2000:] * 3]
    rows = list(enumerate(texts))
    expected = brute.repeats(rows)
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected


def found_repeats(spark, rows, tasks=4, **options):
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(tasks), **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


def test_repeats_of_a_passage_in_very_many_settings(spark, docs):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(40))
    common = [word() for _ in range(6)]
    rows = []
    for i in range(5000):
        ends = [" ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 12))) for _ in range(2)]
        rows.append((i, f"{ends[0]} {passage[rng.randint(0, 9) :] if i % 7 else passage} {ends[1]}"))
    assert found_repeats(spark, rows, 6) == brute.repeats(rows)


@pytest.mark.parametrize("sizes", [(2_000, 1, 1), (3_000, 2, 4), (10**6, 3, 2), (5_000, 10**9, 10**9)])
def test_repeats_with_many_parts_and_hot_grams(spark, docs, monkeypatch, sizes):
    """Parts of a few bytes, sixteen files, tasks that gather little: the same ranges, whatever counts as hot."""
    rows = [(r.doc_id, r.text) for r in docs]
    monkeypatch.setattr(repeats, "SHARD_BYTES", 100)
    monkeypatch.setattr(store, "MOST_FILES", 16)
    assert found_repeats(spark, rows, sizes=repeats.Sizes(*sizes)) == brute.repeats(rows)


# -- language model ----------------------------------------------------------------------------------


def test_language_model(spark, docs):
    expected = brute.language_model([(r.doc_id, r.text) for r in docs])
    for r in QUERIES["op6_language_model"](spark, SF).collect():
        held, n, known, train, base, score = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert near(r.base_score, base) and near(r.score, score)


def test_language_model_with_many_parts(spark, docs, monkeypatch):
    expected = brute.language_model([(r.doc_id, r.text) for r in docs])
    monkeypatch.setattr(language_model, "SHARD_BYTES", 100)
    monkeypatch.setattr(store, "MOST_FILES", 16)
    for r in QUERIES["op6_language_model"](spark, SF).collect():
        assert r.train_tokens == expected[r.doc_id][3] and near(r.base_score, expected[r.doc_id][4]) and near(r.score, expected[r.doc_id][5])


def test_store_keeps_the_maps_used_last(tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_MAPS", 16)
    parts = store.Parts(50, 100)
    hashes = np.sort(np.random.default_rng(15).integers(0, 1 << 64, 20_000, dtype=np.uint64))
    for f, a, b in parts.files_in(hashes):
        store.put(str(tmp_path), f"h-{f}", hashes[a:b])
    assert store.find(hashes, str(tmp_path), "h", parts)[2].all() and len(store._OPEN) <= 16
    assert not store.find(hashes ^ np.uint64(1), str(tmp_path), "h", parts)[2].any()


# -- n-gram join -------------------------------------------------------------------------------------


def plain_components(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = brute.words(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved := [(a, b) for a, b in pairs if label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("pivots", [1, 4])
def test_search_list_finds_all_links(pivots):
    rng = random.Random(5)
    for _ in range(20):
        base = rng.sample(range(10_000), 120)
        members = [np.array(sorted({*rng.sample(base, rng.randint(95, 120)), *rng.sample(range(10_000), rng.randint(0, 8))}), dtype=np.uint64) for _ in range(25)]
        sizes = np.array([len(m) for m in members])
        sets = [set(m.tolist()) for m in members]
        label = list(range(len(sets)))
        changed = True
        while changed:
            changed = False
            for a in range(len(sets)):
                for b in range(a):
                    if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
        assert ngram_join.search_list(sizes, members, 85, pivots=pivots, block=7).tolist() == label


@pytest.mark.parametrize("pivots", [1, 2, 4])
@pytest.mark.parametrize("block", [2, 7, 4096])
def test_search_list_joins_groups_of_two_pivots(pivots, block):
    """Chains whose ends are pivots: what links their groups is a pair of members that each reached one of them."""
    window = lambda at, n=100: np.arange(at, at + n, dtype=np.uint64)
    members = [window(0), window(24), window(8), window(16)]
    assert ngram_join.search_list(np.full(4, 100), members, 85, pivots=pivots, block=block).tolist() == [0, 0, 0, 0]
    rng = random.Random(8)
    for percent in (80, 85):
        for _ in range(20):
            starts = [rng.choice((0, 500, 1000)) + 8 * rng.randint(0, 9) for _ in range(14)]
            members = [window(at, rng.randint(96, 104)) for at in starts]
            sizes = np.array([len(x) for x in members])
            rows = [set(x.tolist()) for x in members]
            label = list(range(len(rows)))
            pairs = [(a, b) for a in label for b in range(a) if 100 * len(rows[a] & rows[b]) >= percent * len(rows[a] | rows[b])]
            while moved := [(a, b) for a, b in pairs if label[a] != label[b]]:
                for a, b in moved:
                    label[a] = label[b] = min(label[a], label[b])
            assert ngram_join.search_list(sizes, members, percent, pivots=pivots, block=block).tolist() == label


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, n, percent):
    expected = plain_components([(r.doc_id, r.text) for r in docs], n, percent)
    found = ngram_join.similar_groups(spark.read.parquet(f"{SF}/documents.parquet"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def numpy_components(rows, percent):
    """Least place reachable by links, of sets given as token lists, by one product of incidence matrices."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r}))}
    held = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, r in enumerate(rows):
        held[i, [vocabulary[t] for t in r]] = 1
    sizes, label = held.sum(axis=1), np.arange(len(rows))
    linked = []
    for a in range(0, len(rows), 500):
        both = held[a : a + 500] @ held.T
        linked += [(a + x, y) for x, y in zip(*np.nonzero(100 * both >= percent * (sizes[a : a + 500, None] + sizes - both)), strict=True)]
    x, y = np.array(linked).T
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        new = new[new]
        if (new == label).all():
            return label.tolist()
        label = new


def near_copies(rng, many):
    """One passage that all share and whose n-grams are nobody's but theirs, in settings that link some and part others."""
    base = [f"b{k}" for k in range(60)]
    out = []
    for i in range(many):
        own = rng.choice(["", "", "x", "y"])
        words = [w if rng.random() > 0.004 else f"e{i}" for w in base]
        words += [f"{own}{k}" for k in range(rng.choice([4, 5, 60]))] if own else []
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_long_list_is_split(spark, monkeypatch, percent):
    """A list of 5,000 different near copies, searched by pivots and blocks, against a brute-force product."""
    rng = random.Random(13)
    texts = near_copies(rng, 5000 if percent == 85 else 700)
    monkeypatch.setattr(ngram_join, "LIST", 64)
    monkeypatch.setattr(ngram_join, "BLOCK", 128)
    rows = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for t in texts)]
    expected = numpy_components(rows, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in ngram_join.similar_groups(df, 4, percent).collect()}
    assert [found[i] for i in range(len(texts))] == expected
    assert 1 < len(set(expected)) < len(texts)


def test_ngram_join_with_many_parts(spark, docs, monkeypatch):
    expected = plain_components([(r.doc_id, r.text) for r in docs], 4, 85)
    monkeypatch.setattr(ngram_join, "SHARD_BYTES", 100)
    monkeypatch.setattr(store, "MOST_FILES", 16)
    monkeypatch.setattr(ngram_join, "LIST", 2)
    found = ngram_join.similar_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_one_of_each_keeps_the_least_of_each_group(spark, docs, odd_docs):
    expected = plain_components([(r.doc_id, r.text) for r in docs], 5, 80)
    kept = ngram_join.one_of_each(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, label) in expected.items() if i == label)
    odd = ngram_join.one_of_each(odd_docs)
    assert odd.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in odd.collect())
    assert ids[40] == 1 and ids[None] == 1 and 5 not in ids and 31 not in ids and ids[30] == 1


def test_components_of_hubs_paths_and_loops(spark):
    rng = random.Random(14)
    edges = [(0, i) for i in range(1, 600)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000, 5000), (7, 1100)]
    edges += [tuple(rng.sample(range(2000, 2400), 2)) for _ in range(250)]
    rng.shuffle(edges)
    label = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in found} == label and len(found) == len(label)


# -- classifier --------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, d).collect()}
    truth = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    held = [(r.predicted, q) for r, q in truth if r.held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())


def test_classifier_gradients_by_finite_differences():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 6))
    weights = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), np.array(0.3)]
    for objective, prior in ((quality_classifier.risk, 0.2), (quality_classifier.risk, 0.99), (quality_classifier.contrast, 0.5)):
        value, grads = quality_classifier.gradients(x, weights, 12, prior, objective)
        for w, grad in zip(weights, grads, strict=True):
            for at in np.ndindex(w.shape):
                kept = float(w[at])
                ends = []
                for shift in (1e-6, -1e-6):
                    w[at] = kept + shift
                    ends.append(quality_classifier.gradients(x, weights, 12, prior, objective)[0])
                w[at] = kept
                assert abs((ends[0] - ends[1]) / 2e-6 - grad[at]) < 1e-6 * (1 + abs(grad[at]))
    signs = [quality_classifier.risk(x @ weights[0][:, 0], 12, prior)[0] for prior in (0.2, 0.99)]
    assert signs[0] > 0 and signs[1] > 0


def test_class_prior_is_the_part_of_positives():
    rng = np.random.default_rng(12)
    draw = lambda n, shift: rng.normal(shift, 1, (n, quality_classifier.FEATURES)).astype(np.float32)
    for prior in (0.3, 0.8):
        n = int(3000 * prior)
        mixed = rng.permutation(np.concatenate([draw(n, 0), draw(3000 - n, 1.5)]))
        assert abs(quality_classifier.class_prior(draw(2000, 0), mixed) - prior) < 0.08


def test_classifier_does_not_use_labels_of_0(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = lambda some: {r.doc_id: r.score for r in quality_classifier.classify(docs, some).collect()}
    every = scores(labels)
    assert every == scores(labels.filter("quality = 1")) and len(set(every.values())) > 2


def test_classifier_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality_classifier.classify(odd_docs, none).collect()} == {0.5}


# -- quality rules -----------------------------------------------------------------------------------


def test_quality_statistics(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    for r in docs:
        w, x = brute.WORD.findall(r.text), rows[r.doc_id]
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        used = [line for line in r.text.split("\n") if brute.WORD.search(line)]
        expected = (len(w), sum(map(len, w)), sum(r.text.count(c) for c in "#*$%&|<>"), len(used) - len(set(used)), len(covered))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == expected
        assert x.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (x.base_failed and x.kept)


def test_quality_keeps_clean_and_drops_marked_up(spark):
    rng = random.Random(6)
    clean = [" ".join(rng.choice(["stone", "river", "and", "the", "of", "walks", "slowly"]) + rng.choice(["", "", "."]) for _ in range(rng.randint(80, 200))) for _ in range(300)]
    bad = [" ".join(w + "%%%" for w in t.split()) for t in clean[:12]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + bad)], "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.keep_good(df).collect()}
    verdict = {r.doc_id: r for r in quality_rules.verdicts(df).collect()}
    assert not kept & set(range(300, 312))
    assert all(i in kept or verdict[i].base_failed for i in range(300))


def test_quality_same_verdicts_by_shuffle(spark, docs, monkeypatch):
    """Many groups: estimates of many languages, joined by shuffle, give the verdicts that broadcast ones do."""
    rows = [(r.doc_id, r.text, f"l{r.doc_id % 30}", f"s{r.doc_id}") for r in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    shown = lambda: {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.verdicts(df).collect()}
    monkeypatch.setattr(quality_rules, "MIN_GROUP", 4)
    expected = shown()
    assert set(expected) == {r.doc_id for r in docs}
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 3)
    assert shown() == expected


def plain_least_determinant(x, starts):
    """Concentration steps in numpy from given starts (mean, inverse factor): mean, inverse factor, log determinant."""
    floors = np.diag([(f * quality_rules.UNIT) ** 2 for f in quality_rules.FLOORS])

    def step(mean, inverse):
        d = (((x - mean) @ inverse.T) ** 2).sum(axis=1)
        bins = np.floor(quality_rules.BINS * np.log2(1 + d))
        edge = np.sort(bins)[int(np.ceil(quality_rules.COVER * len(x))) - 1]
        near = x[bins <= edge]
        spread = np.cov(near.T, bias=True) * quality_rules.CONSISTENCY + floors
        return near.mean(axis=0), np.linalg.inv(np.linalg.cholesky(spread)), np.linalg.slogdet(spread)[1]

    tried = []
    for start in starts:
        for _ in range(quality_rules.FIRST_STEPS):
            start = step(*start[:2])
        tried.append(start)
    best = min(tried, key=lambda t: t[2])
    while (after := step(*best[:2]))[2] < best[2] - 1e-9:
        best = after
    return best


def test_quality_estimates_are_the_least_determinants_found(spark):
    rng, p = np.random.default_rng(10), len(quality_rules.FEATURES)
    groups = {}
    for g in ("a", "b", "c"):
        clean = rng.normal(0, 1, (300, p)) @ rng.normal(0, 60, (p, p)) + 400
        groups[g] = np.round(np.concatenate([clean, rng.normal(1500, 20, (90, p))])).astype(int)
    rows = [(g, int(rng.integers(1 << 60)), *map(int, v)) for g, found in groups.items() for v in found]
    names = ", ".join(f"{f} bigint" for f in quality_rules.FEATURES)
    vectors = spark.createDataFrame(rows, f"g string, _tie bigint, {names}").cache()

    def plain(r):
        inverse = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                inverse[i, j] = r[f"w{i}_{j}"]
        return np.array([r[f"m{i}"] for i in range(p)]), inverse, r.log_det

    starts = defaultdict(list)
    for r in quality_rules.starting(vectors, 3).collect():
        starts[r.g].append(plain(r))
    assert all(len(found) > 2 for found in starts.values())
    for r in quality_rules.estimates(vectors, 3).collect():
        x = groups[r.g].astype(float)
        mean, inverse, det = plain_least_determinant(x, starts[r.g])
        mine = plain(r)
        assert np.allclose(mine[0], mean) and np.allclose(mine[1], inverse, atol=1e-9) and abs(mine[2] - det) < 1e-6
        far = ((((x - mean) @ inverse.T) ** 2).sum(axis=1) > quality_rules.LIMIT).nonzero()[0]
        assert set(range(300, 390)) <= set(far.tolist()) and (far < 300).sum() < 10


# -- mixing ------------------------------------------------------------------------------------------


def plain_mix(rows):
    """Taken words of each row: {(doc_id, text, source): sorted list}, by the order of keys."""
    import hashlib
    import math
    import re

    def key(i, text):
        name = str(i)
        u = (int(hashlib.md5(f"mix-1:{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        marks = len(re.findall(r"[#*$%&|<>]", text or ""))
        return -math.log(u) / (1 / (1 + 20 * marks / max(len(text or ""), 1)))

    by_source = defaultdict(list)
    for i, text, source in rows:
        by_source[source].append((key(i, text), i, len(brute.words(text)), text))
    sizes = {s: sum(x[2] for x in found) for s, found in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    targets, left = {}, 1.5 * sum(sizes.values())
    open_ = list(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            targets[s] = 2 * sizes[s]
            left -= targets[s]
            open_.remove(s)
    targets |= {s: weight[s] * level for s in open_}
    out = defaultdict(list)
    for s, found in by_source.items():
        budget = round(targets[s])
        epochs, rest = divmod(budget, max(1, sizes[s]))
        for _, i, size, text in sorted(found, key=lambda x: x[:3]):
            part = min(size, rest)
            rest -= part
            out[i, text, s].append(epochs * size + part)
    return {k: sorted(v) for k, v in out.items()}, targets


def test_mix_deals_each_of_repeated_rows_its_share(spark):
    rng = random.Random(9)
    rows = [(1, "one two three four five " * 5, "a")] * 30 + [(2, "six seven", "a")] * 7 + [(i, "word " * rng.randint(0, 9), rng.choice("ab")) for i in range(10, 40)]
    rows += [(3, "some % marks # here", "b")] * 11 + [(3, "some % marks # here", None)] * 5 + [(50, None, "a"), (51, "", None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, source string, n_copies string, _size int").repartition(5)
    expected, targets = plain_mix(rows)
    for _ in range(2):
        found = defaultdict(list)
        for r in mixing.mix(df).collect():
            found[r.doc_id, r.text, r.source].append(r.taken_words)
            size = len(brute.words(r.text))
            assert r.n_copies == -(-r.taken_words // max(size, 1)) and r.taken_words <= 2 * size
        assert {k: sorted(v) for k, v in found.items()} == {k: [x for x in v if x] for k, v in expected.items() if any(v)}
    allotted = defaultdict(list)
    for r in mixing.allot(df).collect():
        allotted[r.doc_id, r.source].append(r.taken)
    assert {k: sorted(v) for k, v in allotted.items()} == {(i, s): v for (i, _, s), v in expected.items()}
    words = defaultdict(int)
    for (_, _, s), taken in expected.items():
        words[s] += sum(taken)
    assert all(abs(words[s] - targets[s]) <= 1 for s in words)


def test_mix_with_null_ids_reaches_its_targets(spark, odd_docs):
    by_source, target = defaultdict(int), {}
    many = odd_docs.unionAll(odd_docs.withColumn("doc_id", F.lit(None).cast("bigint")))
    for r in mixing.allot(many).collect():
        target[r.source] = r.target
    for r in mixing.mix(many).collect():
        by_source[r.source] += r.taken_words
    assert all(abs(by_source[s] - t) <= 1 for s, t in target.items())


# -- odd and empty tables ----------------------------------------------------------------------------

WHOLE = {
    "tokens": lambda d: tokens.length_histogram(d), "lines": lambda d: line_dedup.dedup_lines(d), "pieces": lambda d: packing.pack(d), "repeats": lambda d: repeats.remove_repeats(d),
    "model": lambda d: language_model.score_all(d), "join": lambda d: ngram_join.similar_groups(d), "one": lambda d: ngram_join.one_of_each(d), "allot": lambda d: mixing.allot(d),
    "mix": lambda d: mixing.mix(d), "rules": lambda d: quality_rules.verdicts(d), "good": lambda d: quality_rules.keep_good(d),
    "classifier": lambda d: quality_classifier.classify(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_empty_table(no_docs, name):
    assert WHOLE[name](no_docs).count() == 0


@pytest.mark.parametrize("name", ["lines", "repeats", "model", "join", "allot", "rules", "classifier"])
def test_odd_table_keeps_its_rows(odd_docs, name):
    assert WHOLE[name](odd_docs).count() == odd_docs.count()


def test_odd_results(odd_docs):
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(odd_docs).collect()}
    assert [lines[i].n_dropped for i in (10, 15, 16)] == [2, 2, 0] and lines[1].n_lines == 1 and lines[1].text == ""
    joined = {r.doc_id: r for r in ngram_join.similar_groups(odd_docs).collect()}
    assert joined[5].component_id == 4 and joined[8].component_id == 7 and joined[31].component_id == 30 and joined[32].component_id == 30
    assert joined[1].n_shingles == 0 and joined[3].component_id == 3
    cut = {r.doc_id: r for r in repeats.remove_repeats(odd_docs).collect()}
    assert cut[8].n_removed == 300 and cut[7].n_removed == 299 and cut[1].n_bytes == 0
    allotted = mixing.allot(odd_docs).collect()
    assert all(r.taken <= 2 * r.size for r in allotted)
    by_source = defaultdict(int)
    for r in allotted:
        by_source[r.source] += r.taken
    assert all(abs(by_source[r.source] - r.target) <= 1 for r in allotted)
    check_packing([r for r in packing.pack(odd_docs.dropDuplicates(["doc_id"])).collect()], {r.doc_id: r.text for r in odd_docs.dropDuplicates(["doc_id"]).collect()})
    pieces, encode = packing.pack(odd_docs).collect(), encoder()  # repeated rows are packed each
    assert sum(r.length for r in pieces) == sum(len(encode(r.text)) + 1 for r in odd_docs.collect())
    assert Counter(r.doc_id for r in pieces)[40] == 2 and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    lengths = Counter(len(encode(r.text)) for r in odd_docs.collect())
    assert {r.n_tokens: r.n_docs for r in tokens.length_histogram(odd_docs).collect()} == lengths


def plain_lines(rows):
    """Texts without lines whose keys are in five documents or more, but in the largest of them."""
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.ASCII)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    lost = lambda i, line: len(held[key(line)]) >= 5 and i != max(held[key(line)])
    return [(i, "\n".join(line for line in (text or "").split("\n") if not lost(i, line))) for i, text in rows]


def test_pipeline_equals_its_plain_version(spark, monkeypatch):
    """The rules' verdicts are held by tests of their own; all that follows is made again plainly."""
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.verdicts(source).filter("kept").collect()}
    rows = {r.doc_id: r for r in source.collect()}
    texts = plain_lines([(i, rows[i].text) for i in sorted(kept)])
    groups = plain_components(texts, 5, 80)
    texts = [(i, t, rows[i].source) for i, t in texts if groups[i][1] == i]
    taken, _ = plain_mix(texts)
    copies = Counter()
    for (i, text, _), words in taken.items():
        size = len(brute.words(text))
        copies[i] += sum(-(-w // max(size, 1)) for w in words if w)
    packed = corpus_pipeline.run(spark, SF).collect()
    encode, text_of = encoder(), {i: t for i, t, _ in texts}
    tokens_of = {i: len(encode(text_of[i])) + 1 for i in copies if copies[i]}
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.length
    assert words == Counter({i: n * copies[i] for i, n in tokens_of.items()})
    for r in packed:
        ids = np.array([*encode(text_of[r.doc_id]), 2], dtype="<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == tokens_of[r.doc_id]
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for found in by_sequence.values():
        ends = [a + n for a, n in sorted(found)]
        assert [a for a, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    import corpus_pipeline

    for table in (odd_docs, no_docs):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, SF)
            assert made.columns == corpus_pipeline.COLUMNS, name
            made.collect()
            docs = table if name == "quality_rules" else made
        assert corpus_pipeline.packed(spark, docs, SF).count() >= docs.count()


def test_keep_good_on_odd_table(odd_docs):
    text = " ".join(f"some plain words number {chr(97 + i % 26) * (1 + i % 5)}" for i in range(30))
    rows = odd_docs.unionByName(odd_docs.limit(1).select(*[F.lit(text).alias(c) if c == "text" else F.col(c) for c in odd_docs.columns]))
    good = quality_rules.keep_good(rows)
    verdict = Counter(r.kept for r in quality_rules.verdicts(rows).collect())
    assert good.columns == odd_docs.columns and good.count() == verdict[True] and verdict[True] + verdict[False] == rows.count()


# -- least values of hot groups ----------------------------------------------------------------------


def test_group_least_joins_back_every_row(spark):
    rows = [("hot" if i % 3 else f"g{i}", None if i % 7 == 0 else i) for i in range(4000)] + [("nulls", None), ("hot", 5), ("hot", 5)]
    df = spark.createDataFrame(rows, "g string, i bigint")
    groups = components.group_least(df, "g", "i", "i")
    found = Counter((r.g, r.i, r.least) for r in components.join_back(df, groups, "g", "i").collect())
    least = {g: min((i for h, i in rows if h == g and i is not None), default=None) for g, _ in rows if g in ("hot", "nulls")}
    assert found == Counter((g, i, least[g] if g in least else i) for g, i in rows)
    hot = groups.filter("g = 'hot'").first()
    assert len(hot.salts) == len(set(hot.salts)) > 500
