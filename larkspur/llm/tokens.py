"""Tokenization by public vocabularies, and the exact length histogram of a corpus.

Edge cases: NULL and empty texts have length 0; empty corpora give an empty histogram; any columns beside
the text are left alone, whatever their names; repeated rows and equal lengths count each. Very long texts
are encoded whole, part by part between blanks.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import memory

VOCABULARY = "word_bpe_49k.json"
# Parts and words whose ids a worker remembers, twice (about 200 MB).
MEMO_WORDS = 600_000
# Texts whose words are learnt in one call.
TOGETHER = 256
# Words that one call of the tokenizer takes.
AT_ONCE = 1024
# The ASCII marks, which the vocabulary splits from letters.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Parts(dict):
    """Ids of parts; one not remembered gets an empty place, the same until ``places`` is replaced."""

    def __init__(self):
        super().__init__({"": b""})
        self.places: dict[str, bytearray] = {}

    def __missing__(self, part: str) -> bytearray:
        place = self.places.get(part)
        if place is None:
            place = self.places[part] = bytearray()
        return place


class WordMemo:
    """Encodes texts word by word with a bounded memory of words.

    The vocabulary drops white space before it splits, lowers case, and splits letters from marks, so a
    text's ids are those of its parts between blanks and line feeds, one after the other, and those of
    a part of letters with marks behind are the letters' and the marks'. Ids come as little-endian
    uint32 bytes. Words met first fill the memory; later ones are encoded without being kept.

    Lower-case words of Latin letters, which normalization leaves as they are, are encoded many in one text by
    the model alone. The id that ends a word parts them; where the ends are not one a word, each goes by itself.
    """

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.parts, self.cores = limit, _Parts(), {"": b""}
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _alone(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {word: array("I", x.ids).tobytes() for word, x in zip(words, found, strict=True)}

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of Latin letters."""
        raw = array("I", self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids).tobytes()
        stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
        if len(stops) != len(words):
            return self._alone(words)
        return {word: raw[a:b] for word, a, b in zip(words, [0, *stops], stops, strict=False)}

    def _encoded(self, words: Iterable[str]) -> dict[str, bytes]:
        plain, other = [], []
        for word in words:
            # No letter below U+0250 is changed by NFC, and every version of Unicode in use calls it one.
            (plain if word.isalpha() and (word.isascii() or max(word) < "\u0250") and word == word.lower() else other).append(word)
        out = {}
        for some, encode in ((plain, self._joined), (other, self._alone)):
            for i in range(0, len(some), AT_ONCE):
                out |= encode(some[i : i + AT_ONCE])
        return out

    def _fill(self, places: dict[str, bytearray]) -> None:
        """Puts their ids into the places of the parts that are not remembered."""
        cores = self.cores
        split = []
        for part in places:
            core = part.rstrip(MARKS)
            if core.isalpha() and "\u03a3" not in core:  # a capital sigma lowers by its place
                split.append((core.lower(), part[len(core) :]))
            else:
                split.append((part, ""))
        found = self._encoded(set(chain.from_iterable(split)).difference(cores))
        for key in islice(found, max(0, self.limit - len(cores))):
            cores[key] = found[key]
        for (core, tail), place in zip(split, places.values(), strict=True):
            place += found[core] if core in found else cores[core]
            if tail:
                place += found[tail] if tail in found else cores[tail]
        for part in islice(places, max(0, self.limit - len(self.parts))):
            self.parts[part] = bytes(places[part])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        texts = iter(texts)
        while group := list(islice(texts, TOGETHER)):
            memory.busy()
            self.parts.places, known = {}, self.parts.__getitem__
            found = [list(map(known, (text or "").replace("\n", " ").split(" "))) for text in group]
            self._fill(self.parts.places)
            yield from map(b"".join, found)


_MEMOS: dict[str, WordMemo] = {}
memory.when_idle(_MEMOS.clear)


def word_memo(path: str) -> WordMemo:
    """The process's memory for a vocabulary, kept from task to task."""
    if path not in _MEMOS:
        _MEMOS[path] = WordMemo(path)
    return _MEMOS[path]


def token_lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens of every row's text."""
    path = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = word_memo(path)
        for batch in batches:
            yield pd.Series([len(ids) // 4 for ids in words.encode(batch)], dtype="int64")

    return docs.select(lengths(F.col(text)).alias("n_tokens"))


def length_histogram(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """One row per encoded length L with what suffix sums answer for a context limit of L:

    n_docs of that length, docs_longer and tokens_longer above it, total_docs, total_tokens,
    truncated_tokens (every document cut at L), tokens_lost to that cut, and share_at_most, the part
    of documents that fit. Only the histogram, which has at most as many rows as the longest document
    has tokens, goes through the one ordered window; documents are summed before the shuffle.
    """
    counts = token_lengths(docs, path, text).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    above = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counts.select(
        "n_tokens", "n_docs",
        F.coalesce(F.sum("n_docs").over(above), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(tokens).over(above), F.lit(0)).alias("tokens_longer"),
        F.sum("n_docs").over(whole).alias("total_docs"),
        F.sum(tokens).over(whole).alias("total_tokens"),
    )
    cut = F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer")
    return out.withColumns({
        "truncated_tokens": F.col("total_tokens") - cut,
        "tokens_lost": cut,
        "share_at_most": 1 - F.col("docs_longer") / F.col("total_docs"),
    })


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, lengths in the corpus or not, from the histogram alone."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x, 0, True) for x in sorted(set(limits))], "n_tokens bigint, n_docs bigint, asked boolean")
    both = histogram.select("n_tokens", "n_docs", F.lit(False).alias("asked")).unionAll(asked)
    # Lengths up to a limit come before it, a limit itself last.
    upto = Window.orderBy("n_tokens", "asked").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("n_tokens", "asked").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens, limit = F.col("n_tokens") * F.col("n_docs"), F.col("n_tokens")
    sums = both.select("n_tokens", "asked", *[F.sum(v).over(w).alias(k) for k, v, w in (
        ("docs_fitting", F.col("n_docs"), upto), ("_short", tokens, upto), ("_docs", F.col("n_docs"), whole), ("_tokens", tokens, whole)
    )])
    cut = F.col("_short") + limit * (F.col("_docs") - F.col("docs_fitting"))
    return sums.filter("asked").select(limit.alias("context_limit"), "docs_fitting", cut.alias("truncated_tokens"), (F.col("_tokens") - cut).alias("tokens_lost"))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share q of documents does not exceed."""
    row = histogram.filter(F.col("total_docs") - F.col("docs_longer") >= q * F.col("total_docs")).agg(F.min("n_tokens")).first()
    return row[0] if row else None
