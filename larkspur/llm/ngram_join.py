"""Similarity join of documents on word n-grams by T-occurrence search.

1. Every document is its set of n-gram hashes. Sets are counted: each task sends sorted arrays by hash range,
   and those n-grams found in two or more documents are kept as sorted hash arrays in the shared folder, a
   bounded number of files.
2. A link needs an overlap of at least the threshold times the larger set, so a document fewer of whose
   n-grams are shared has no link. The others keep their shared n-grams, rarest first, in an array store.
   Documents with equal sets are one class.
3. Two linked classes share one of the rarest n-grams of each (as many as may differ, and one). Inverted
   lists over these are the candidates. Lists with the same members are searched once.
4. A list is searched by DivideSkip: the short lists of a probe are merged, what they leave undecided is
   probed in the long ones by bisection, and documents reaching the required overlap are links. Documents
   that link with one of the list's pivots are connected already and need a search of their own only where
   they are near another pivot's group; so a list of thousands of near copies costs a comparison each, and
   no pairs are written. Only what connects a group is written.
5. A list of more than LIST members is not gathered: its members meet its pivots where they are, those that
   need a search and all members are dealt into blocks, and blocks of one meet blocks of the other by an
   equality join on their numbers.
6. Links join classes to components. Least ids go back to classes and documents by group and salt, so that
   a component or a set of copies may hold a third of all rows.

Ids are integers (cast to bigint). Edge cases: NULL, empty and blank texts have no n-grams and link with
nothing. A shorter text is one n-gram of all its words. A NULL doc_id takes part and is never a component's
id where another is. Repeated rows and equal sets are one class. Very long texts are cut into n-grams whole.
Extra columns are left out of ``similar_groups`` and survive ``one_of_each``, whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import counting, store
from larkspur.llm.components import components, group_least, join_back, salt
from larkspur.llm.counting import PACKED
from larkspur.llm.hashing import grouped, mix, shingle_sets
from larkspur.llm.text import carried, unpacked
from larkspur.session import fresh_dir, written

# Bytes of text a part of the n-gram counts stands for.
SHARD_BYTES = 24 << 20
# Bytes of text looked up together: at least so many, and more for each file to look into.
TOGETHER, TOGETHER_A_FILE = 1 << 20, 8 << 10
# Pivots of a list; members of an index block; most members of a list that one task searches, and of a block of a longer one.
PIVOTS, INDEX_MEMBERS, LIST, BLOCK = 4, 4096, 512, 256
# Parts in which a long list meets what is known of it, at most.
SALTS = 1024
# List members that a task searches, on average.
SEARCHED = 4_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix(tokens + np.uint64(len(tokens))).sum(dtype=np.uint64)
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def count_shared(docs: DataFrame, folder: str, parts: store.Parts, n: int) -> None:
    """Sorted arrays df-<file> and their counts dfn-<file> of the n-grams in two or more documents."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for group in grouped(pdf["text"]):
                for tokens in shingle_sets(group, n):
                    held.append(tokens)
                    size += len(tokens)
                if size > counting.GATHERED:
                    yield from counting.pack(held, parts.files_in)
                    held, size = [], 0
        if size:
            yield from counting.pack(held, parts.files_in)

    def merged(f: int, found) -> Iterator[pd.DataFrame]:
        with store.writing(folder, [f"df-{f}", f"dfn-{f}"]) as (df, dfn):
            for _, keys, total in found:
                shared = total > 1
                df(keys[shared])
                dfn(total[shared].astype("<u4"))
        yield pd.DataFrame([(f,)], columns=["file"])

    packed = docs.select("text").mapInPandas(counted, PACKED)
    subs_in = lambda f, keys: store.runs_of(parts.part_of(keys) - f * parts.subs)
    done = {r.file for r in counting.by_file(packed, parts.files, parts.subs, subs_in, merged, "file int").collect()}  # a row per file
    store.fill(folder, ["df", "dfn"], parts.files, done)


def required(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def sets(docs: DataFrame, folder: str, parts: store.Parts, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key of every row; tokens (sorted) and prefix of those that may have links."""

    shaped = lambda rows: pd.DataFrame(rows, columns=["doc_id", "n_shingles", "key", "tokens", "prefix"]).astype({"doc_id": "Int64"})

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, ids, held = [], iter(pdf["doc_id"]), 0
            for group in grouped(pdf["text"], max(TOGETHER, parts.files * TOGETHER_A_FILE)):
                found = shingle_sets(group, n)
                flat = np.concatenate(found)
                order = np.argsort(flat, kind="stable")
                file, place, hit = store.find(flat[order], folder, "df", parts)
                places, df = np.flatnonzero(hit), np.zeros(len(flat), dtype=np.int64)
                for f, a, b in store.runs_of(file[places]):
                    df[order[places[a:b]]] = store.get(folder, f"dfn-{f}", "<u4")[place[places[a:b]]]
                at = 0
                for tokens in found:
                    times, size = df[at : at + len(tokens)], len(tokens)
                    at += size
                    shared = times > 1
                    least = -(-percent * size // 100)
                    many = int(shared.sum())
                    if size and many >= least:
                        own, times = tokens[shared], times[shared]
                        rare = np.lexsort((own, times))[: many - least + 1]
                        rows.append((next(ids), size, set_key(tokens), own.tobytes(), _signed(own[rare]).tolist()))
                        held += own.nbytes + rare.nbytes
                    else:
                        rows.append((next(ids), size, set_key(tokens) if size else 0, None, None))
                    if held > counting.BATCH_BYTES:
                        yield shaped(rows)
                        rows, held = [], 0
            yield shaped(rows)

    return docs.mapInPandas(taken, "doc_id bigint, n_shingles bigint, key bigint, tokens binary, prefix array<bigint>")


def store_sets(classes: DataFrame, folder: str) -> DataFrame:
    """Writes the classes' tokens to array files; key, n, prefix, file, at, size to find them."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for pdf in batches:
            name = f"sets-{uuid.uuid4().hex}"
            sizes = [len(t) // 8 for t in pdf.tokens]
            store.put(folder, name, np.frombuffer(b"".join(pdf.tokens), "<u8"))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if sizes else []
            yield pd.DataFrame({"key": pdf.key, "n": pdf.n, "prefix": pdf.prefix, "file": name, "at": starts, "size": sizes})

    # Written, not recomputed: each attempt's files have names of their own, and the table names the ones it kept.
    return written(classes.mapInPandas(save, "key bigint, n bigint, prefix array<bigint>, file string, at bigint, size bigint"), "sets")


def divide_skip(lists: list[np.ndarray], least: int, long_lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in at least ``least`` of the sorted lists, and in how many: merge the short, probe the long."""
    lists = sorted(lists, key=len)
    long_lists = min(long_lists, least - 1, len(lists) - 1)
    short, long = lists[: len(lists) - long_lists], lists[len(lists) - long_lists :]
    members, counts = np.unique(np.concatenate(short), return_counts=True)
    open_ = counts >= least - len(long)
    members, counts = members[open_], counts[open_]
    for left, found in zip(range(len(long) - 1, -1, -1), long, strict=True):
        if not len(members):
            break
        at = np.minimum(np.searchsorted(found, members), len(found) - 1)
        counts = counts + (found[at] == members)
        going = counts >= least - left
        members, counts = members[going], counts[going]
    return members, counts


class _Links:
    """Union-find over the members of one list."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def overlaps(tokens: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """How many tokens of each sorted set the pivot has."""
    flat = np.concatenate(tokens)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]])
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), bounds)


def probe(index: list[np.ndarray], sizes: np.ndarray, asked: list[np.ndarray], asked_sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place in ``asked``, places in ``index``) of the sets that link, by T-occurrence search."""
    flat = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), [len(t) for t in index])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for x, (tokens, size) in enumerate(zip(asked, asked_sizes.tolist(), strict=True)):
        low, high = np.searchsorted(flat, tokens), np.searchsorted(flat, tokens, side="right")
        lists = [owner[i:j] for i, j in zip(low, high, strict=True) if j > i]
        least = -(-percent * size // 100)
        if len(lists) >= least:
            members, counts = divide_skip(lists, least, int(0.8 * least))
            yield x, members[counts >= required(sizes[members], size, percent)]


def search_list(sizes: np.ndarray, tokens: list[np.ndarray], percent: int, pivots: int = PIVOTS, block: int = INDEX_MEMBERS) -> np.ndarray:
    """For each member of a list the first member of its group of links. ``tokens``: sorted shared n-grams."""
    m = len(sizes)
    links, reached, nearby = _Links(m), np.zeros(m, dtype=bool), []
    # Jaccard distance is a metric: what links with a pivot's neighbour is at most twice as far from the pivot.
    wide = max(0, 2 * percent - 100)
    for _ in range(min(pivots, m)):
        left = np.flatnonzero(~reached)
        if not len(left):
            break
        p = int(left[0])
        reached[p] = True
        for a in range(0, m, block):
            some = np.arange(a, min(m, a + block))
            some = some[(100 * np.minimum(sizes[some], sizes[p]) >= wide * np.maximum(sizes[some], sizes[p])) & (some != p)]
            if not len(some):
                continue
            overlap = overlaps([tokens[i] for i in some], tokens[p])
            for i in some[overlap >= required(sizes[some], int(sizes[p]), percent)]:
                links.join(int(i), p)
                reached[i] = True
            nearby.append((p, some[overlap >= required(sizes[some], int(sizes[p]), wide)]))
    # A member that no pivot reached is searched against all. A reached one is connected to its pivot's group,
    # and can link another group only from near that group's pivot; of two groups the smaller one is searched.
    search = ~reached
    roots = np.array([links.root(i) for i in range(m)])
    members = np.bincount(roots, minlength=m)
    for p, some in nearby:
        own, other = roots[some], roots[p]
        smaller = (members[own] < members[other]) | ((members[own] == members[other]) & (own > other))
        search[some[(own != other) & smaller]] = True
    alone = np.flatnonzero(search)
    for a in range(0, m if len(alone) else 0, block):
        b = min(m, a + block)
        for x, found in probe(tokens[a:b], sizes[a:b], [tokens[i] for i in alone], sizes[alone], percent):
            for y in found:
                links.join(int(alone[x]), int(y) + a)
    return np.array([links.root(i) for i in range(m)])


def _loaded(folder: str, pdf: pd.DataFrame) -> list[np.ndarray]:
    return [store.get(folder, f, "<u8")[a : a + s] for f, a, s in zip(pdf["file"], pdf["at"], pdf["size"], strict=True)]


MEMBER = "token bigint, key bigint, n bigint, file string, at bigint, size bigint"
LINK = "a bigint, b bigint"


def lists_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (MEMBER) of each list that is searched: those of at most LIST members, and those of longer lists,
    with m and the keys of the list's pivots. ``found``: see ``store_sets``."""
    postings = written(found.select("key", F.explode("prefix").alias("token")).withColumn("_salt", salt("key")), "postings")
    mark = lambda seed: F.xxhash64(F.lit(seed), "key")
    drawn = [F.min(F.struct(mark(10 + p).alias("by"), F.col("key"))).alias(f"p{p}") for p in range(PIVOTS)]
    parts = postings.groupBy("token", "_salt").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark(1)).alias("x"), F.bit_xor(mark(2)).alias("y"), *drawn)
    sums = [F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.collect_list("_salt").alias("salts")]
    shapes = parts.groupBy("token").agg(*sums, *[F.min(f"p{p}").alias(f"p{p}") for p in range(PIVOTS)]).filter("m > 1")
    nth = F.row_number().over(Window.partitionBy("m", "x", "y").orderBy("token"))
    chosen = shapes.withColumn("_nth", nth).filter("_nth = 1").withColumn("pivots", F.array_distinct(F.array(*[f"p{p}.key" for p in range(PIVOTS)])))
    chosen = chosen.select("token", "m", F.when(F.col("m") > LIST, F.col("pivots")).alias("pivots"), F.explode("salts").alias("_salt"))
    about = found.select("key", "n", "file", "at", "size")
    members = written(postings.join(chosen, ["token", "_salt"]).drop("_salt").join(about, "key"), "members")
    columns = [c.split()[0] for c in MEMBER.split(", ")]
    return members.filter(F.col("m") <= LIST).select(*columns), members.filter(F.col("m") > LIST).select(*columns, "m", "pivots")


def links(found: DataFrame, folder: str, percent: int) -> DataFrame:
    """a, b: links between classes, enough to connect all that link."""
    short, long = lists_of(found)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        keys = pdf.key.to_numpy()
        root = search_list(pdf.n.to_numpy(), _loaded(folder, pdf), percent)
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": keys[linked], "b": keys[root[linked]]})

    tasks = int(min(20_000, max(16, short.count() // SEARCHED)))
    near = short.repartition(tasks, "token").groupBy("token").applyInPandas(search, LINK)
    return (near.unionAll(long_links(long, found, folder, percent)) if long.limit(1).count() else near).distinct()


def pivot_groups(masks: list[tuple[int, int]], pivots: int) -> tuple[list[int], list[int]]:
    """Group of each pivot and the members of each group (by its first pivot), from (pivots linked, how many members)."""
    joined = _Links(pivots)
    for mask, _ in masks:
        linked = [p for p in range(pivots) if mask >> p & 1]
        for p in linked[1:]:
            joined.join(linked[0], p)
    group, sizes = [joined.root(p) for p in range(pivots)], [0] * pivots
    for mask, times in masks:
        if mask:
            sizes[group[(mask & -mask).bit_length() - 1]] += times
    return group, sizes


def long_links(long: DataFrame, found: DataFrame, folder: str, percent: int) -> DataFrame:
    """Links of lists that no task gathers, by pivots and blocks."""
    wide = max(0, 2 * percent - 100)
    # Pivots are some members each of few lists: they travel with their list's members.
    of_list = long.select("token", "m", "pivots").dropDuplicates(["token"])
    stored = of_list.select("token", F.posexplode("pivots").alias("p", "key")).join(found.select("key", "n", "file", "at", "size"), "key")
    stored = stored.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("p", "key", "n", "file", "at", "size"))).alias("pivots"))
    salts = F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.col("m") / LIST), F.lit(SALTS)).cast("int") - 1)).alias("_part")
    known = of_list.select("token", "m", salts).join(stored, "token")
    part = lambda m: F.pmod(F.xxhash64("key"), F.least(F.ceil(m / LIST), F.lit(SALTS))).cast("int")
    met = long.drop("pivots").withColumn("_part", part(F.col("m"))).join(known.drop("m"), ["token", "_part"]).drop("_part")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked, close = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            tokens, sizes = _loaded(folder, pdf), pdf.n.to_numpy()
            for places in pdf.groupby("token", sort=False).indices.values():
                for pivot in pdf.pivots.iloc[places[0]]:
                    own = store.get(folder, pivot["file"], "<u8")[pivot["at"] : pivot["at"] + pivot["size"]]
                    overlap = overlaps([tokens[i] for i in places], own)
                    bit = 1 << pivot["p"]
                    linked[places] |= np.where(overlap >= required(sizes[places], pivot["n"], percent), bit, 0)
                    close[places] |= np.where(overlap >= required(sizes[places], pivot["n"], wide), bit, 0)
            yield pdf.drop(columns="pivots").assign(linked=linked, close=close, keys=[[p["key"] for p in some] for some in pdf.pivots])

    met = written(met.mapInPandas(meet, f"{MEMBER}, m bigint, linked bigint, close bigint, keys array<bigint>"), "met")
    to_pivots = met.select(F.col("key").alias("a"), F.posexplode("keys").alias("p", "b"), "linked").filter("getbit(linked, p) = 1 and a <> b").select("a", "b")

    @F.pandas_udf("group array<int>, members array<bigint>")
    def grouped_pivots(masks: pd.Series, pivots: pd.Series) -> pd.DataFrame:
        found = [pivot_groups([(r["linked"], r["times"]) for r in some], n) for some, n in zip(masks, pivots, strict=True)]
        return pd.DataFrame({"group": [x[0] for x in found], "members": [x[1] for x in found]})

    times = met.groupBy("token", "linked", "m", F.size("keys").alias("pivots")).agg(F.count(F.lit(1)).alias("times"))
    state = times.groupBy("token", "m", "pivots").agg(F.collect_list(F.struct("linked", "times")).alias("masks"))
    state = state.withColumn("_groups", grouped_pivots("masks", "pivots")).select("token", salts, F.col("_groups.group").alias("group"), F.col("_groups.members").alias("members"))
    asked = met.withColumn("_part", part(F.col("m"))).join(state, ["token", "_part"]).drop("_part")
    # Who needs a search: see ``search_list``; a pivot's bit stands for the pivot.
    first = F.log2(F.col("linked").bitwiseAND(-F.col("linked"))).cast("int")
    own = F.get("group", first)
    smaller = lambda p: (F.get("members", own) < F.get("members", F.get("group", p))) | ((F.get("members", own) == F.get("members", F.get("group", p))) & (own > F.get("group", p)))
    beside = F.exists(F.sequence(F.lit(0), F.size("group") - 1), lambda p: (F.getbit(F.col("close"), p) == 1) & (F.get("group", p) != own) & smaller(p))
    asked = written(asked.filter((F.col("linked") == 0) | beside).select("token", "key", "n", "file", "at", "size", "m"), "asked")
    if not asked.limit(1).count():
        return to_pivots
    blocks = lambda count: F.ceil(count / BLOCK).cast("int")
    block = lambda count: F.pmod(F.xxhash64("key", "token"), blocks(count)).cast("int")
    many = asked.groupBy("token").agg(F.count(F.lit(1)).alias("u"))
    salted = many.join(of_list.select("token", "m"), "token").select("token", "u", salts)
    with_u = lambda df: df.withColumn("_part", part(F.col("m"))).join(salted, ["token", "_part"]).drop("_part")
    columns = ["token", "key", "n", "file", "at", "size", "i", "j", "probe"]
    every = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
    index = with_u(met).withColumns({"i": block(F.col("m")), "probe": F.lit(False)}).withColumn("j", every(F.col("u")))
    probes = with_u(asked).withColumns({"j": block(F.col("u")), "probe": F.lit(True)}).withColumn("i", every(F.col("m")))
    both = index.select(*columns).unionByName(probes.select(*columns))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, sizes, asks = _loaded(folder, pdf), pdf.n.to_numpy(), pdf.probe.to_numpy()
        index, probes = np.flatnonzero(~asks), np.flatnonzero(asks)
        joined = _Links(len(pdf))
        if len(index) and len(probes):
            for x, hits in probe([tokens[i] for i in index], sizes[index], [tokens[i] for i in probes], sizes[probes], percent):
                for y in hits:
                    joined.join(int(probes[x]), int(index[y]))
        root = np.array([joined.root(i) for i in range(len(pdf))])
        keys = pdf.key.to_numpy()
        linked = keys != keys[root]
        return pd.DataFrame({"a": keys[linked], "b": keys[root[linked]]})

    pairs = many.join(of_list.select("token", "m"), "token").agg(F.sum(F.ceil(F.col("m") / BLOCK) * F.ceil(F.col("u") / BLOCK))).first()[0]
    tasks = int(min(20_000, max(16, pairs // 2)))
    return to_pivots.unionAll(both.repartition(tasks, "token", "i", "j").groupBy("token", "i", "j").applyInPandas(search, LINK))


def similar_groups(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (of the set) and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, folder = store.parts_for(size, SHARD_BYTES), fresh_dir(spark, "ngrams")
    count_shared(docs, folder, parts, n)
    every = written(sets(docs, folder, parts, n, percent), "documents")
    classes = every.filter("tokens is not null").select("key", F.col("n_shingles").alias("n"), "tokens", "prefix").dropDuplicates(["key"])
    found = store_sets(classes, folder)
    labels = components(links(found, folder, percent))
    shown = every.select("doc_id", "n_shingles", "key")
    full = shown.filter("n_shingles > 0")
    sets_of = group_least(full, "key", "doc_id", "doc_id").withColumnsRenamed({"least": "_first", "salts": "_parts"})
    named = sets_of.join(labels, sets_of.key == labels.node, "left").withColumn("_label", F.coalesce("label", "key"))
    named = join_back(named, group_least(named, "_label", "key", "_first"), "_label", "key")
    classed = named.select("key", F.col("least").alias("component_id"), F.col("_parts").alias("salts"))
    out = join_back(full, classed, "key", "doc_id").select("doc_id", "n_shingles", "key", "component_id")
    return out.unionByName(shown.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """The documents whose id is their component's, one row of each."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = similar_groups(docs, n, percent, **options).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    keyed = carried(docs.dropDuplicates([id_col, text_col]), _own=F.col(id_col))
    return keyed.join(kept, F.col("_own").eqNullSafe(F.col("_id")), "left_semi").select(*unpacked(docs))
