"""Quality rules: robust multivariate outliers per language and source. DataFrame functions only.

Each document has integer statistics; documents that fail the base rules go. The others are vectors of
transformed statistics, in integer steps so that sums are exact whatever their order. Per language and
source a minimum covariance determinant estimate is searched from several starts: coordinatewise medians,
and STARTS subsets of about SUBSET documents drawn by digest. A concentration step takes the COVER share of
documents nearest to an estimate and gives their mean and covariance. Every start makes FIRST_STEPS steps;
the one of least determinant goes on until its determinant falls no more, and the least one met wins. The
radius that covers the share comes of a histogram of distances (integer counts), so no group is sorted or
collected: it is the upper edge of a bin of 1/256 of an octave. A document is rejected when its Mahalanobis
distance under the estimate exceeds the limit. Groups of fewer than MIN_GROUP documents borrow their
language's estimate, small languages that of all documents. FLOORS keep statistics that hardly vary from
rejecting small deviations.

Edge cases: NULL and blank texts have no words and fail the base rules. NULL language or source is a
group value. Repeated rows count each; documents of equal distance are covered together. Very long texts
are measured whole. Extra columns are left out of ``verdicts`` and survive ``keep_good``, whatever their
names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.text import SPACE, carried, let, lines, stripped, unpacked, words
from larkspur.session import written

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
COVER, MIN_GROUP = 0.75, 200
STARTS, SUBSET, FIRST_STEPS, MOST_STEPS = 5, 6, 2, 30
# Bins per octave of a distance.
BINS = 256
# 0.9999 quantile of chi-square with 5 degrees of freedom, and the consistency factor of a
# 0.75 cover in 5 dimensions.
LIMIT, CONSISTENCY = 25.74, 1.43
FEATURES = ("f_length", "f_symbols", "f_upper", "f_lines", "f_repeat")
# Steps per unit of a transformed statistic, and the least deviation, in units, that counts as usual.
UNIT = 256
FLOORS = (0.06, 0.06, 0.06, 0.08, 0.06)
# Broadcast group estimates only up to so many groups; beyond, they are joined by shuffle, a group's rows in so many parts.
BROADCAST_GROUPS, SALTS = 20_000, 64


def _repeated(found: Column, n: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the array of window hashes."""

    def cover(order: Column) -> Column:
        same = lambda a, b: F.get(order, a)["h"].eqNullSafe(F.get(order, b)["h"])
        hits = F.filter(F.transform(order, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
        gaps = lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x
        )
        return let(F.sort_array(hits), gaps)

    ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(ordered, cover))


def _windows(parts: Column) -> Column:
    """64-bit hashes of all runs of WINDOW words."""
    last = F.size(parts) - WINDOW
    hashed = lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(WINDOW)])
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), hashed))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines_used, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    used = F.filter(lines(text), lambda x: stripped(x) != "")
    counted = docs.withColumns({"_words": words(text), "_used": used})
    counted = counted.withColumn("_windows", _windows(F.col("_words")))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    out = counted.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("bigint"),
        "n_symbols": (F.length(text) - without("[#*$%&|<>]+")).cast("bigint"),
        "n_dup_lines": (F.size("_used") - F.size(F.array_distinct("_used"))).cast("bigint"),
        "n_repeat_words": _repeated(F.col("_windows"), F.size("_words")).cast("bigint"),
        "n_upper": (F.length(text) - without("[A-Z]+")).cast("bigint"),
        "n_lines_used": F.size("_used").cast("bigint"),
    }).drop("_words", "_used", "_windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _features() -> list[Column]:
    """Transformed statistics in integer steps."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    raw = (
        F.ln(chars / n), F.ln(1 + F.col("n_symbols") / n), F.ln(1 + 4 * F.col("n_upper") / chars),
        F.ln(1 + F.col("n_dup_lines") / F.greatest(F.col("n_lines_used"), F.lit(1))), F.ln(1 + F.col("n_repeat_words") / n),
    )
    return [F.round(F.least(x, F.lit(8.0)) * UNIT).cast("bigint").alias(name) for x, name in zip(raw, FEATURES, strict=True)]


def _solved(stats: DataFrame) -> DataFrame:
    """From counts, sums and product sums of (g, start): means m_i, the inverse Cholesky factor w_ij of the covariance, and log_det."""
    p, n = len(FEATURES), F.col("n").cast("double")
    df = stats.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            spread = (F.col(f"s{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
            df = df.withColumn(f"c{i}_{j}", spread + (F.lit((FLOORS[i] * UNIT) ** 2) if i == j else F.lit(0.0)))
    for j in range(p):  # Cholesky factor by columns
        done = [F.col(f"l{j}_{k}") for k in range(j)]
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - sum((x * x for x in done), F.lit(0.0)), F.lit(1e-6))))
        df = df.withColumns({
            f"l{i}_{j}": (F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}") for i in range(j + 1, p)
        })
    for i in range(p):  # its inverse by rows
        df = df.withColumns({
            f"w{i}_{j}": F.lit(1.0) / F.col(f"l{i}_{i}") if i == j
            else -sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}_{i}") for j in range(i + 1)
        })
    return df.withColumn("log_det", 2 * sum((F.ln(f"l{i}_{i}") for i in range(1, p)), F.ln("l0_0"))).select(*ESTIMATE)


# The columns of an estimate.
ESTIMATE = ["g", "start", *[f"m{i}" for i in range(len(FEATURES))], *[f"w{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1)], "log_det"]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that carries its group's estimate."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = sum((F.col(f"w{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def _with(df: DataFrame, known: DataFrame, groups: int, on: tuple[str, ...] = ("g",)) -> DataFrame:
    """``df`` (with _tie, a digest of the row) joined with what is known of its group."""
    if groups <= BROADCAST_GROUPS:
        return df.join(F.broadcast(known), list(on))
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod("_tie", F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def _moments(df: DataFrame) -> DataFrame:
    p = len(FEATURES)
    sums = {f"s{i}": F.sum(FEATURES[i]) for i in range(p)} | {f"s{i}_{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(p) for j in range(i + 1)}
    return df.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])


def _medians(vectors: DataFrame) -> DataFrame:
    """Estimates (start 0) from coordinatewise medians and median absolute deviations, by histograms of integer steps."""

    def middles(counts: DataFrame, out: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("g", "f").orderBy("v"))
        total = F.sum("n").over(Window.partitionBy("g", "f"))
        return counts.withColumn("_hit", 2 * upto >= total).filter("_hit").groupBy("g", "f").agg(F.min("v").alias(out))

    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v")) for i, c in enumerate(FEATURES)])).alias("x")
    counts = vectors.select("g", pairs).groupBy("g", "x.f", "x.v").agg(F.count(F.lit(1)).alias("n"))
    medians = middles(counts, "m")
    # Deviations are counted from the counted values: no document goes to its group's task.
    off = counts.join(medians, ["g", "f"]).groupBy("g", "f", F.abs(F.col("v") - F.col("m")).alias("v")).agg(F.sum("n").alias("n"))
    both = medians.join(middles(off, "d"), ["g", "f"])
    p = len(FEATURES)
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("f") == i, F.col(c))).cast("double").alias(f"{c}{i}") for i in range(p) for c in ("m", "d")])
    variance = lambda i: (1.4826 * F.col(f"d{i}")) ** 2 + (FLOORS[i] * UNIT) ** 2
    made = {f"w{i}_{j}": F.lit(0.0) for i in range(p) for j in range(i)} | {f"w{i}_{i}": 1 / F.sqrt(variance(i)) for i in range(p)}
    return wide.withColumns(made | {"start": F.lit(0), "log_det": sum((F.ln(variance(i)) for i in range(1, p)), F.ln(variance(0)))}).select(*ESTIMATE)


def _subsets(vectors: DataFrame, groups: int) -> DataFrame:
    """Estimates (starts 1 to STARTS) from subsets of about SUBSET rows that a digest draws."""
    sizes = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("_of"))
    drawn = lambda k: F.pmod(F.xxhash64(F.lit(k), "_tie"), F.lit(1 << 31)) * F.col("_of") < SUBSET * (1 << 31)
    starts = F.array_compact(F.array(*[F.when(drawn(k), F.lit(k)) for k in range(1, STARTS + 1)]))
    return _solved(_moments(_with(vectors, sizes, groups).withColumn("start", F.explode(starts))))


def starting(vectors: DataFrame, groups: int) -> DataFrame:
    return _medians(vectors).unionByName(_subsets(vectors, groups))


def concentrated(vectors: DataFrame, found: DataFrame, groups: int, cover: float = COVER) -> DataFrame:
    """The estimates of the documents nearest to those ``found``."""
    near = _with(vectors, found, groups).withColumn("_bin", F.floor(BINS * F.log2(1 + _distance())).cast("int"))
    counts = near.groupBy("g", "start", "_bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "start").orderBy("_bin"))
    total = F.sum("n").over(Window.partitionBy("g", "start"))
    edges = counts.withColumn("_hit", upto >= cover * total).filter("_hit").groupBy("g", "start").agg(F.min("_bin").alias("_edge"))
    return _solved(_moments(_with(near, edges, groups, ("g", "start")).filter(F.col("_bin") <= F.col("_edge"))))


def estimates(vectors: DataFrame, groups: int, cover: float = COVER) -> DataFrame:
    """Minimum covariance determinant estimate of each group ``g`` of integer vectors. ``vectors``: g, FEATURES, _tie."""
    found = written(starting(vectors, groups), "estimate")
    for _ in range(FIRST_STEPS):
        found = written(concentrated(vectors, found, groups, cover), "estimate")
    least = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy("g").orderBy("log_det", "_step", "start"))).filter("_nth = 1").drop("_nth")
    best = written(least(found.withColumn("_step", F.lit(0))), "estimate")
    for step in range(1, MOST_STEPS):
        going = best.filter(F.col("_step") == step - 1).drop("_step")
        if not going.limit(1).count():
            break
        # A step that does not lower the determinant is not taken, and ends its group's search.
        after = concentrated(vectors, going, groups, cover).withColumns({"_step": F.lit(step), "log_det": F.col("log_det") + 1e-9})
        best = written(least(best.unionByName(after)), "estimate")
    return best.drop("_step")


def _group(lang: Column | None, source: Column | None) -> Column:
    shown = lambda c: F.lit("*") if c is None else F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return F.concat_ws("\x01", shown(lang), shown(source))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_ALL = "*\x01*"


def _judged(measured: DataFrame, shown: list[str], limit: float) -> DataFrame:
    """``shown`` columns, distance and kept of every row of a written table of statistics (with _tie, _own, _wide)."""
    passed = measured.filter(~F.col("base_failed"))
    sizes = passed.groupBy("_own", "_wide").agg(F.count(F.lit(1)).alias("_n"))
    wide_n = F.sum("_n").over(Window.partitionBy("_wide"))
    g = F.when(F.col("_n") >= MIN_GROUP, F.col("_own")).when(wide_n >= MIN_GROUP, F.col("_wide")).otherwise(F.lit(_ALL))
    named = written(sizes.select("_own", g.alias("g")), "groups")
    groups = named.count()
    chosen = _with(passed, named, groups, ("_own",))
    # A shared estimate is made of all documents it stands for, those of large groups too.
    needed = named.select("g").distinct().filter(F.col("g").endswith("\x01*"))
    vectors = chosen.filter(~F.col("g").endswith("\x01*")).select("g", "_tie", *FEATURES)
    if needed.limit(1).count():
        shared = passed.withColumn("g", F.explode(F.array(F.col("_wide"), F.lit(_ALL))))
        vectors = vectors.unionByName(_with(shared, needed, groups).select("g", "_tie", *FEATURES))
    scored = _with(chosen, estimates(vectors, groups), groups).withColumn("distance", _distance())
    kept = scored.select(*shown, "distance", (F.col("distance") <= limit).alias("kept"))
    lost = measured.filter("base_failed").select(*shown, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return kept.unionByName(lost)


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Numbered columns of ``docs`` with its statistics, transformed ones, _tie, _own and _wide."""
    keys = {"_id": F.col(id_col), "_text": F.col(text_col), "_lang": F.col(lang_col), "_source": F.col(source_col)}
    stats = statistics(carried(docs, **keys), "_text")
    tie = F.xxhash64(F.col("_id").cast("string"), F.col("_text")).alias("_tie")
    groups = _group(F.col("_lang"), F.col("_source")).alias("_own"), _group(F.col("_lang"), None).alias("_wide")
    return stats.select("_id", *[c for c in stats.columns if c.startswith("_carried")], *COUNTS, tie, *_features(), *groups)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """doc_id, statistics, base_failed, distance (NULL where the base failed) and kept of every row."""
    measured = _measured(docs, id_col, text_col, lang_col, source_col)
    measured = written(measured.drop(*[c for c in measured.columns if c.startswith("_carried")]), "statistics")
    return _judged(measured.withColumnRenamed("_id", "doc_id"), ["doc_id", *COUNTS], limit)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """The documents that the rules keep. They are written beside their statistics once, and not shuffled."""
    measured = written(_measured(docs, id_col, text_col, lang_col, source_col).drop("_id"), "measured")
    held = [c for c in measured.columns if c.startswith("_carried")]
    return _judged(measured, held, limit).filter("kept").select(*unpacked(docs))
