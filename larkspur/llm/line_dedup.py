"""Line dedup: lines found in many documents stay in one of them. DataFrame functions only.

Only hashes travel: occurrences of long lines are range partitioned by key hash with a secondary sort by
document and position, first occurrences per document are streamed out of the sorted runs, and what comes
back is a compressed keep bitmap per document, not text: of its words of 64 lines only those that lose a
line, by their place; all other words are ones. A key may be in a third of all documents, so its occurrences
are salted by document and split over ranges before the streaming pass, and the keys join back by salt too.

Edge cases: NULL or empty text is one empty line, which stays. A NULL doc_id counts as one document below
all others. Rows with the same doc_id count as one document, however often they repeat a line; identical
rows have identical results. Very long texts are split whole, and their bitmaps grow with dropped lines
only. Empty tables give empty results, and extra columns are carried through ``dedup_lines`` unless they
clash with n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.text import ascii_lower, carried, cell, let, lines, stripped, unpacked
from larkspur.session import written

MIN_CHARS, MIN_DOCS = 40, 5
# Ranges over which the occurrences of one key can spread.
SALTS = 1024


def _row_key(id_col: str, text_col: str):
    """The document's id and a hash of its text: rows with one id and different texts stay apart."""
    return F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """_id, _hash, _pos, _k1, _k2, _salt: every line whose key is long enough, by a 128-bit hash of its key."""
    each = docs.select(*_row_key(id_col, text_col), F.posexplode(lines(F.col(text_col))).alias("_pos", "_line"))
    keyed = each.select("_id", "_hash", "_pos", stripped(F.col("_line")).alias("_line")).filter(F.length("_line") >= min_chars)
    key = ascii_lower(F.col("_line"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("_salt")
    return keyed.select("_id", "_hash", "_pos", F.xxhash64(key).alias("_k1"), F.xxhash64(F.lit("line"), key).alias("_k2"), salt)


def repeated_keys(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """_k1, _k2, _salt, _keeper: keys in at least ``min_docs`` documents and the largest document holding each.

    A row for each salt that the key's documents have: no more rows than occurrences.
    """
    salted = found.select("_k1", "_k2", "_salt", "_id", "_pos")
    dealt = salted.repartitionByRange("_k1", "_k2", "_salt").sortWithinPartitions("_k1", "_k2", "_salt", F.desc("_id"), "_pos")
    run = Window.partitionBy("_k1", "_k2", "_salt").orderBy(F.desc("_id"), "_pos")
    previous = F.lag(F.struct("_id")).over(run)
    firsts = dealt.withColumn("_first", previous.isNull() | ~previous["_id"].eqNullSafe(F.col("_id"))).filter("_first")
    by_salt = firsts.groupBy("_k1", "_k2", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keeper"))
    keys = by_salt.groupBy("_k1", "_k2").agg(F.sum("_n").alias("_n"), F.max("_keeper").alias("_keeper"), F.collect_list("_salt").alias("_salts"))
    return keys.filter(F.col("_n") >= min_docs).select("_k1", "_k2", F.explode("_salts").alias("_salt"), "_keeper")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_id, _hash, keep: a row per document that loses lines. ``keep`` holds, in order, the words of the keep
    bitmap that are not all ones: bit i % 64 of the word with ``at`` = i // 64 is set where line i stays."""
    found = written(occurrences(docs, id_col, text_col, min_chars), "lines")
    keys = repeated_keys(found, min_docs)
    lost = found.join(keys, ["_k1", "_k2", "_salt"]).filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
    word = F.expr("cast(_pos div 64 as int)")
    bits = lost.groupBy("_id", "_hash", word.alias("at")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, _pos % 64)"))).alias("bits"))
    return bits.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("keep"))


def unpacked_bitmap(keep: Column) -> Column:
    """All words of a bitmap up to its last that is not all ones."""

    def expand(word: Column, i: Column) -> Column:
        gap = word["at"] - F.coalesce(F.get(keep, i - 1)["at"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(-1).cast("bigint"), gap), F.array(word["bits"]))

    return F.flatten(F.transform(keep, expand))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their kept lines joined again, and n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    docs = docs.drop("n_lines", "n_dropped")
    own, text_hash = _row_key(id_col, text_col)
    keyed = carried(docs, _own=own, _own_hash=text_hash)
    joined = keyed.join(bitmaps, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left")
    text = F.coalesce(cell(docs, text_col), F.lit(""))
    every = lines(text)
    stays = lambda words, i: F.coalesce(F.getbit(F.get(words, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1
    kept = let(unpacked_bitmap(F.col("keep")), lambda words: F.filter(every, lambda _, i: stays(words, i)))
    dropped = F.aggregate(F.col("keep"), F.lit(0).cast("bigint"), lambda n, w: n + 64 - F.bit_count(w["bits"]))
    return joined.select(
        *unpacked(docs, **{text_col: F.when(F.col("keep").isNull(), text).otherwise(F.array_join(kept, "\n"))}),
        F.size(every).cast("bigint").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("bigint").alias("n_dropped"),
    )
