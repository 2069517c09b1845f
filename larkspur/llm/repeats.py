"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of the places that can repeat.

A string of SPAN bytes has an anchor: the place of the least hash among its grams of GRAM bytes. Equal strings
have equal anchors at equal places, so strings meet by the hash of the anchor's gram, whatever documents they
are in. Neighbouring strings with one anchor are one run; a run travels as hashes only.

1. Runs are dealt by gram. Of equal runs (same bytes, same anchor place) the earliest stays and the others
   are repeats; equal runs of one task are settled there, so frequent passages are not gathered. A gram with
   one run left is done.
2. Grams with several different runs are contested: strings in them may be equal in part. Their texts are
   fetched by a second scan, and suffix arrays are made by induced sorting, whole grams to an array. Strings
   next to each other in order whose common prefix is SPAN or more are equal; the earliest stays, the others
   are repeats.
3. A hot gram, in very many different runs (a passage in very many settings), is not gathered: a task
   that meets many of its runs says so and passes them on, its other runs follow when they reach the gram's
   part. Their texts are dealt by run, every string is named by its hash, strings are settled where they are
   and then dealt by that name, as runs were.
4. Repeats are merged per document and kept as sorted arrays in the shared folder, which the last scan maps.

Everything dealt by hash goes to a bounded number of files, and in a file's task to parts of bounded size that
Spark sorts (see ``store``). Order is by doc_id, then start. Texts never travel but for contested and hot runs.

Ids are integers (cast to bigint). Edge cases: NULL is empty; texts under SPAN bytes lose nothing. Rows equal
in id and text are one document, with one result each; of one id's different texts the order is by hash. A
NULL id is below all others. Very long texts are worked in parts. Extra columns are left out, whatever their
names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import memory, store
from larkspur.llm.counting import held_rows, streamed
from larkspur.llm.hashing import _BASE, _BYTE, _INVERSE, _power, mix
from larkspur.llm.suffix_array import common_prefixes, suffix_array
from larkspur.session import fresh_dir, written

SPAN, GRAM = 100, 32
PART, SHARD_BYTES = 1 << 19, 12 << 20
# Bytes of contested text in one suffix array.
ARRAY_BYTES = 1 << 20
NULL_ID = -(1 << 63)


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), F.encode(text, "UTF-8").alias("data"))


def doc_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(np.uint64)) + hashes.view(np.uint64))


def parts_of(datas: list[bytes], span: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (document, first byte, bytes) of about PART bytes. Parts of a long text share span - 1 bytes."""
    group, size = [], 0
    for i, data in enumerate(datas):
        for at in range(0, max(1, len(data) - span + 1), PART):
            piece = data if len(data) <= PART else data[at : at + PART + span - 1]
            if len(piece) < span:
                continue
            group.append((i, at, piece))
            size += len(piece)
            if size >= PART:
                memory.busy()
                yield group
                group, size = [], 0
    if group:
        yield group


def runs(group: list[tuple[int, int, bytes]], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first byte, last start minus first, gram hash and class hash of every run of a group."""
    data = b"".join(x[2] for x in group)
    n = len(data)
    padded = np.frombuffer(data + b"\0" * (gram + 8), dtype=np.uint8)
    wide = np.ndarray(shape=(n + gram,), dtype="<u8", buffer=padded, strides=(1,))
    g = np.zeros(n, dtype=np.uint64)
    for k in range(0, gram, 8):
        g += wide[k : k + n] * _BYTE[k]
    g = mix(g)
    width = span - gram + 1
    # Place of the leftmost least hash among the next 1, 2, 4 ... places, and by two overlapping runs of any width.
    least, at, have = g.copy(), np.arange(n, dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        other = least[step:] < least[:-step]
        at[:-step] = np.where(other, at[step:], at[:-step])
        least[:-step] = np.where(other, least[step:], least[:-step])
        have += step
    sizes = np.array([len(x[2]) for x in group])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    usable = np.zeros(n + 1, dtype=np.int8)
    usable[begins] += 1
    np.subtract.at(usable, begins + sizes - span + 1, 1)
    starts = np.flatnonzero(np.cumsum(usable[:n]) > 0)
    anchor = at[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    low, high = starts[first], starts[np.concatenate([first[1:] - 1, [len(starts) - 1]])]
    mark = anchor[first].astype(np.int64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[padded[:n]] * _power(_BASE, n), out=sums[1:])
    body = (sums[high + span] - sums[low]) * _power(_INVERSE, n + 1)[low]
    kind = mix(body + mix(((high - low) << 16 | (mark - low)).astype(np.uint64)))
    where = np.searchsorted(begins, low, side="right") - 1
    offset = np.array([x[1] for x in group])[where] - begins[where]
    doc = np.array([x[0] for x in group])[where]
    # Least hashes are small ones: mixed again they spread over all shards.
    return doc, low + offset, high - low, mix(g[mark] + np.uint64(1)), kind


_COLUMNS = ["file", "sub", "kind", "h", "c", "doc", "low", "width", "ids", "ths"]
_SCHEMA = "file int, sub int, kind int, h binary, c binary, doc binary, low binary, width binary, ids binary, ths binary"
# RUNS and STRINGS go by their gram or name; REPEATS, CONTESTED and HOT_RUNS (of gram 0) by document. SAID names hot grams.
RUNS, SAID, REPEATS, CONTESTED, HOT_RUNS, STRINGS = range(6)
_NONE = np.empty(0, "<u8")


def _row(file: int, sub: int, kind: int, h, c, doc, low, width, ids, ths) -> tuple:
    used, local = np.unique(doc, return_inverse=True)
    return (file, sub, kind, h.tobytes(), c.tobytes(), local.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.astype("<u4").tobytes(), ids[used].tobytes(), ths[used].tobytes())


def _read(rows: list) -> tuple[np.ndarray, ...]:
    """h, c, doc, low, width, ids, ths of packed rows, doc a place in ids and ths."""
    ids = [np.frombuffer(r.ids, "<i8") for r in rows]
    shift = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).astype(np.int64) if rows else []
    load = lambda name, kind: np.frombuffer(b"".join(getattr(r, name) for r in rows), kind)
    doc = np.concatenate([np.frombuffer(r.doc, "<u4").astype(np.int64) + s for r, s in zip(rows, shift, strict=True)]) if rows else np.empty(0, np.int64)
    return load("h", "<u8"), load("c", "<u8"), doc, load("low", "<u4").astype(np.int64), load("width", "<u4").astype(np.int64), load("ids", "<i8"), load("ths", "<i8")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _dealt(kind: int, by: np.ndarray, place: Callable[[int], tuple[int, int]], h, c, doc, low, width, ids, ths) -> list[tuple]:
    """A row for each value of ``by``. ``h`` and ``c`` may be None."""
    order, rows = np.argsort(by, kind="stable"), []
    some = lambda x, at: _NONE if x is None else x[at]
    for value, a, b in store.runs_of(by[order]):
        at = order[a:b]
        rows.append(_row(*place(value), kind, some(h, at), some(c, at), doc[at], low[at], width[at], ids, ths))
    return rows


def _by_file(kind: int, parts: store.Parts, h, c, doc, low, width, ids, ths) -> list[tuple]:
    """Rows by the file of their gram (RUNS, STRINGS) or document."""
    keys = h if kind in (RUNS, STRINGS) else doc_keys(ids, ths)[doc]
    return _dealt(kind, parts.file_of(keys), lambda f: (f, 0), h, c, doc, low, width, ids, ths)


def _said(parts: store.Parts, grams: np.ndarray) -> list[tuple]:
    none, grams = np.empty(0, np.int64), np.sort(grams)
    return [_row(f, 0, SAID, grams[a:b], _NONE, none, none, none, np.empty(0, "<i8"), np.empty(0, "<i8")) for f, a, b in parts.files_in(grams)]


def _said_in(f: int, parts: store.Parts, grams: np.ndarray) -> list[tuple]:
    """The rows of hot grams dealt to the parts of a file."""
    none, rows, grams = np.empty(0, np.int64), [], np.sort(grams)
    for s, a, b in store.runs_of(_sub_of(f, parts, grams)):
        rows.append(_row(f, s, SAID, grams[a:b], _NONE, none, none, none, np.empty(0, "<i8"), np.empty(0, "<i8")))
    return rows


def _per_gram(grams: np.ndarray) -> np.ndarray:
    """How many entries have the gram of each."""
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    return counts[back]


def _settled(kind: int, parts: store.Parts, found: tuple[np.ndarray, ...], hot_from: int) -> list[tuple]:
    """Rows of the earliest of equal runs, of the others as repeats, and of grams that have ``hot_from`` different runs or more."""
    h, c, doc, low, width, ids, ths = found
    first, again = _settle(h, c, doc, low, ids, ths)
    rows = _by_file(REPEATS, parts, None, None, doc[again], low[again], width[again], ids, ths)
    if kind == RUNS:
        hot = _per_gram(h[first]) >= hot_from
        some = first[hot]
        rows += _by_file(HOT_RUNS, parts, np.zeros(len(some), "<u8"), None, doc[some], low[some], width[some], ids, ths) + _said(parts, np.unique(h[some]))
        first = first[~hot]
    return rows + _by_file(kind, parts, h[first], c[first], doc[first], low[first], width[first], ids, ths)


@dataclass(frozen=True)
class Sizes:
    """Runs that a task gathers; different runs that make a gram hot in what a task gathers, and in a part."""

    gathered: int = 500_000
    task_hot: int = 64
    hot: int = 256


def _by_part(df: DataFrame, parts: store.Parts, divide: Callable[[int, list], list[tuple]], sizes: Sizes) -> DataFrame:
    """Rows of a file in one task, in the order of its parts. ``divide(file, rows)`` deals gathered rows to parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, rows in groupby(streamed(batches), key=lambda r: r.file):
            for some in held_rows(rows, lambda r: max(1, len(r.low) // 4), sizes.gathered):
                yield _frame(divide(f, some))

    dealt = df.repartition(parts.files, "file")
    if parts.subs > 1:
        dealt = dealt.sortWithinPartitions("file").mapInPandas(run, _SCHEMA)
    return dealt.sortWithinPartitions("file", "sub")


def _sub_of(f: int, parts: store.Parts, keys: np.ndarray) -> np.ndarray:
    return parts.part_of(keys) - f * parts.subs


def _settle_all(df: DataFrame, parts: store.Parts, kind: int, sizes: Sizes) -> DataFrame:
    """Repeats, and of RUNS the contested and hot ones. ``df``: rows of ``kind`` and SAID."""

    def divide(f: int, rows: list) -> list[tuple]:
        own = [r for r in rows if r.kind == kind]
        out = []
        # Settled again: what a task gathers of a part grows with its different runs only.
        for r in _settled(kind, parts, _read(own), sizes.task_hot) if own else []:
            if r[2] in (kind, SAID):
                h = np.frombuffer(r[3], "<u8")
                if r[2] == SAID:
                    out += _said_in(f, parts, h)
                else:
                    out += _dealt(kind, _sub_of(f, parts, h), lambda s: (f, s), *_read([_Packed(*r)]))
            else:
                out.append(r)
        for r in rows:
            if r.kind == SAID:
                out += _said_in(f, parts, np.frombuffer(r.h, "<u8"))
            elif r.kind != kind:
                out.append(tuple(r))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def part(rows: list) -> list[tuple]:
            own = [r for r in rows if r.kind == kind]
            out = [tuple(r) for r in rows if r.kind not in (kind, SAID)]
            if not own:
                return out
            h, c, doc, low, width, ids, ths = _read(own)
            first, again = _settle(h, c, doc, low, ids, ths)
            out += _by_file(REPEATS, parts, None, None, doc[again], low[again], width[again], ids, ths)
            if kind == RUNS:
                said = np.concatenate([_NONE, *[np.frombuffer(r.h, "<u8") for r in rows if r.kind == SAID]])
                many = _per_gram(h[first])
                hot = (many > sizes.hot) | np.isin(h[first], said)
                for what, some in ((HOT_RUNS, first[hot]), (CONTESTED, first[~hot & (many > 1)])):
                    out += _by_file(what, parts, h[some] * np.uint64(what == CONTESTED), None, doc[some], low[some], width[some], ids, ths)
            return out

        for _, rows in groupby(streamed(batches), key=lambda r: (r.file, r.sub)):
            memory.busy()
            for r in part(list(rows)):
                held.append(r)
                size += len(r[6]) // 4
            if size > sizes.gathered:
                yield _frame(held)
                held, size = [], 0
        if held:
            yield _frame(held)

    return _by_part(df, parts, divide, sizes).mapInPandas(run, _SCHEMA)


def _settle(h, c, doc, low, ids, ths) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest run of every class, and of the others. Runs of one place count once, as the earliest."""
    key = mix(h ^ mix(c))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    firsts = [order[~many]]
    some = order[many]
    if not len(some):
        return firsts[0], some
    by = np.lexsort((low[some], ths[doc[some]], ids[doc[some]], key[some]))
    some = some[by]
    head = np.concatenate([[True], key[some][1:] != key[some][:-1]])
    leader = some[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
    same_place = (ids[doc[some]] == ids[doc[leader]]) & (ths[doc[some]] == ths[doc[leader]]) & (low[some] == low[leader])
    return np.concatenate([firsts[0], some[head]]), some[~same_place]


class _Packed:
    """A row of _COLUMNS by name."""

    def __init__(self, *values):
        self.__dict__.update(zip(_COLUMNS, values, strict=True))


def _joined(found: tuple[np.ndarray, ...], span: int) -> tuple[np.ndarray, ...]:
    """Document keys, first and last bytes of repeats, joined where they touch, in order."""
    _, _, doc, low, width, ids, ths = found
    keys, high = doc_keys(ids, ths)[doc], low + width + span
    order = np.lexsort((low, keys))
    keys, low, high = keys[order], low[order], high[order]
    # Within a document ends so far are kept by lifting each document above all before it.
    if len(keys):
        rank = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        lift = rank * (1 << 40)
        reach = np.maximum.accumulate(high + lift)
        new = np.concatenate([[True], (low + lift)[1:] > reach[:-1]])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
        keys, low, high = keys[new], low[new], (reach - lift)[last]
    return keys.astype("<u8"), low.astype("<u8"), high.astype("<u8")


def _wanted(found: tuple[np.ndarray, ...], _: int) -> tuple[np.ndarray, ...]:
    """Document keys, first bytes, widths and grams of runs whose texts are wanted, in order. Hot ones have gram 0."""
    h, _, doc, low, width, ids, ths = found
    keys = doc_keys(ids, ths)[doc]
    order = np.lexsort((low, keys))
    return tuple(x[order].astype("<u8") for x in (keys, low, width, h))


CUT, WANT = ["cut", "cutlow", "cuthigh"], ["want", "wantlow", "wantwidth", "wanth"]


def _write_arrays(df: DataFrame, folder: str, names: list[str], parts: store.Parts, span: int, made_of: Callable, sizes: Sizes) -> None:
    """Sorted arrays by document key of all rows of ``df``, a file of each name per file."""

    def divide(f: int, rows: list) -> list[tuple]:
        h, c, doc, low, width, ids, ths = _read(rows)
        subs = _sub_of(f, parts, doc_keys(ids, ths)[doc])
        return _dealt(0, subs, lambda s: (f, s), h if len(h) else None, None, doc, low, width, ids, ths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, of_file in groupby(streamed(batches), key=lambda r: r.file):
            with store.writing(folder, [f"{name}-{f}" for name in names]) as outs:
                for _, rows in groupby(of_file, key=lambda r: r.sub):
                    for out, values in zip(outs, made_of(_read(list(rows)), span), strict=True):
                        out(values)
            yield pd.DataFrame([(f,)], columns=["file"])

    made = {r.file for r in _by_part(df.withColumn("sub", F.lit(0)), parts, divide, sizes).mapInPandas(run, "file int").collect()}  # a row per file
    store.fill(folder, names, parts.files, made)


def equal_strings(contexts: list[bytes], widths: np.ndarray, order: np.ndarray, lows: np.ndarray, span: int) -> list[np.ndarray]:
    """For each context, which of its string starts repeat an earlier one. ``order``, ``lows``: the documents' order and first bytes."""
    sizes = np.array([len(x) for x in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = b"\0".join(contexts) + b"\0"
    s = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 2
    s[begins + sizes] = 1
    array = suffix_array(np.concatenate([s, [0]]), 258, span)[1:]
    shared = common_prefixes(data, array, span)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    start = np.arange(len(data)) - begins[owner]
    whole = start <= widths[owner]
    # Behind a suffix that is no whole string nothing equal can stand: what has the same first bytes is whole too.
    fresh = (shared[array] < span) | ~np.concatenate([[False], whole[array[:-1]]])
    array, fresh = array[whole[array]], fresh[whole[array]]
    group = np.cumsum(fresh)
    by = np.lexsort(((lows[owner] + start)[array], order[owner][array], group))
    array, group = array[by], group[by]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    leader = array[np.maximum.accumulate(np.where(head, np.arange(len(array)), 0))]
    same = (order[owner[array]] == order[owner[leader]]) & ((lows[owner] + start)[array] == (lows[owner] + start)[leader])
    hit = np.zeros(len(data), dtype=bool)
    hit[array[~same]] = True
    return [np.flatnonzero(hit[b : b + w + 1]) for b, w in zip(begins, widths, strict=True)]


def _strings(contexts: list[bytes], widths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context and place of every string of the contexts."""
    sizes = np.array([len(x) for x in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    owner = np.repeat(np.arange(len(contexts)), widths + 1)
    place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(widths + 1)[:-1]]), widths + 1)
    start = begins[owner] + place
    return mix((sums[start + span] - sums[start]) * _power(_INVERSE, len(data) + 1)[start]), owner, place


def find_repeats(docs: DataFrame, folder: str, parts: store.Parts, span: int, gram: int, sizes: Sizes) -> None:
    """Arrays cut-<file>, cutlow-<file>, cuthigh-<file> of the byte ranges to remove, by document key."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, ids, ths, docs_held = [], 0, [], [], 0

        def send() -> pd.DataFrame:
            doc, low, width, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            return _frame(_settled(RUNS, parts, (h, c, doc, low, width, np.concatenate(ids), np.concatenate(ths)), sizes.task_hot))

        for pdf in batches:
            ids.append(pdf.doc_id.to_numpy("<i8"))
            ths.append(pdf.th.to_numpy("<i8"))
            for group in parts_of(list(pdf.data), span):
                doc, *rest = runs(group, span, gram)
                held.append((doc + docs_held, *rest))
                size += len(doc)
            docs_held += len(pdf)
            if size > sizes.gathered:
                yield send()
                held, size, ids, ths, docs_held = [], 0, [], [], 0
        if size:
            yield send()

    sent = docs.mapInPandas(scan, _SCHEMA)
    # Repeats and hot runs of the first scan travel with the runs, to the tasks of their documents' files, and pass through.
    found = written(_settle_all(sent, parts, RUNS, sizes), "repeats")
    _write_arrays(found.filter(F.col("kind").isin(CONTESTED, HOT_RUNS)), folder, WANT, parts, span, _wanted, sizes)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, ths = pdf.doc_id.to_numpy("<i8"), pdf.th.to_numpy("<i8")
            keys, rows = doc_keys(ids, ths), []
            for i, f, a, b in _ranges(keys, folder, "want", parts):
                data = pdf.data.iloc[i]
                lows, widths, hs = (store.get(folder, f"{x}-{f}", "<u8")[a:b].astype(np.int64 if x != "wanth" else np.uint64) for x in WANT[1:])
                # Hot runs need no meeting: they are dealt by document.
                files = parts.file_of(np.where(hs == 0, mix(keys[i] + lows.astype(np.uint64)), hs))
                rows += [(int(x), int(ids[i]), int(ths[i]), int(lo), int(w), int(h.view(np.int64)), data[lo : lo + w + span]) for x, lo, w, h in zip(files, lows, widths, hs, strict=True)]
            yield pd.DataFrame(rows, columns=["file", "doc_id", "th", "low", "width", "h", "context"])

    def by_gram(rows: Iterator) -> Iterator[list]:
        """Whole grams of about ARRAY_BYTES; rows of gram 0 in any portions."""
        held, size = [], 0
        for h, some in groupby(rows, key=lambda r: r.h):
            if held and h == 0:
                yield held
                held, size = [], 0
            for r in some:
                held.append(r)
                size += len(r.context)
                if h == 0 and size >= ARRAY_BYTES:
                    yield held
                    held, size = [], 0
            if held and (h == 0 or size >= ARRAY_BYTES):
                yield held
                held, size = [], 0
        if held:
            yield held

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in by_gram(streamed(batches)):
            memory.busy()
            ids, ths, lows, widths = (np.array([getattr(r, x) for r in some], dtype="<i8") for x in ("doc_id", "th", "low", "width"))
            contexts = [r.context for r in some]
            if some[0].h == 0:
                h, owner, place = _strings(contexts, widths, span)
                yield _frame(_settled(STRINGS, parts, (h, h, owner, lows[owner] + place, np.zeros(len(h), dtype=np.int64), ids, ths), 0))
                continue
            order = np.unique(np.stack([ids, ths], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            hits = equal_strings(contexts, widths, order, lows, span)
            owner, place = np.repeat(np.arange(len(some)), [len(x) for x in hits]), np.concatenate(hits)
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]) if len(owner) else np.empty(0, dtype=bool)
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:] - 1, [len(owner) - 1]]) if len(owner) else heads
            yield _frame(_by_file(REPEATS, parts, None, None, owner[heads], lows[owner[heads]] + place[heads], place[tails] - place[heads], ids, ths))

    schema = "file int, doc_id bigint, th bigint, low bigint, width bigint, h bigint, context binary"
    contexts = docs.mapInPandas(fetch, schema).repartition(parts.files, "file").sortWithinPartitions("h", "doc_id", "th", "low")
    more = written(contexts.mapInPandas(compare, _SCHEMA), "compared")
    named = _settle_all(more.filter(F.col("kind") == STRINGS), parts, STRINGS, sizes)
    repeats = F.col("kind") == REPEATS
    _write_arrays(found.filter(repeats).unionByName(more.filter(repeats)).unionByName(named), folder, CUT, parts, span, _joined, sizes)


def _ranges(keys: np.ndarray, folder: str, name: str, parts: store.Parts) -> Iterator[tuple[int, int, int, int]]:
    """(row, file, from, to) of the rows that have entries in a sorted array with repeated keys."""
    order = np.argsort(keys)
    for f, x, y in parts.files_in(keys[order]):
        mine, found = order[x:y], store.get(folder, f"{name}-{f}", "<u8")
        low, high = np.searchsorted(found, keys[mine]), np.searchsorted(found, keys[mine], side="right")
        for i, a, b in zip(mine.tolist(), low.tolist(), high.tolist(), strict=True):
            if b > a:
                yield i, f, a, b


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, with_kept: bool = True, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed ranges and (unless left out) kept bytes of every row."""
    spark = docs.sparkSession
    source = _identity(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts, folder = store.parts_for(size, SHARD_BYTES, 16), fresh_dir(spark, "repeats")
    find_repeats(source, folder, parts, span, gram, sizes)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = {i: (s, a, b) for i, s, a, b in _ranges(doc_keys(pdf.doc_id.to_numpy("<i8"), pdf.th.to_numpy("<i8")), folder, "cut", parts)}
            rows = []
            for i, (doc_id, data) in enumerate(zip(pdf.doc_id, pdf.data, strict=True)):
                lows = highs = []
                kept = data
                if i in spans:
                    s, a, b = spans[i]
                    lows, highs = (store.get(folder, f"{x}-{s}", "<u8")[a:b].tolist() for x in ("cutlow", "cuthigh"))
                    kept = b"".join(data[x:y] for x, y in zip([0, *highs], [*lows, len(data)], strict=True))
                rows.append((None if doc_id == NULL_ID else doc_id, len(data), len(data) - len(kept), len(lows), hashlib.sha256(kept).hexdigest(), lows, highs, *([kept] if with_kept else [])))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", *(["kept"] if with_kept else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>" + ", kept binary" * with_kept
    return source.mapInPandas(apply, schema)
