"""Quality rules: minimum-covariance-determinant outliers per language and source.

Only DataFrame expressions are used, on the main path and elsewhere. Word statistics of each whole
text become a vector of variance-stabilised shares (angles ``2 asin(sqrt(share))``) and the log of
the mean word length. Deviations from the group's medians are damped for short texts, whose shares
are noisy, and rounded to integers so that sums do not depend on the order of rows.

For every group the covariance of least determinant is sought by concentration steps: the three
quarters of the rows nearest in Mahalanobis distance give the next centre and scatter, until
determinants settle. There are three starts: medians with squared median absolute deviations, mean
and covariance of all rows, and those of the deviations damped by a hyperbolic tangent. Of the three
ends the one of least determinant is the group's estimate. It is scaled so that the median squared
distance is that of a chi-squared variable, and rows beyond a cutoff are rejected.

A group is a (language, source) pair of at least ``MIN_GROUP`` rows that pass the base rule. A pair
of fewer rows, from which a scatter of four dimensions would be mostly noise, is judged by the
estimate of its language, and a language of fewer by that of the whole table. Estimates come from
all rows that pass the base rule. Rows of one group never meet in one task: medians and quantiles are
taken from counts of rounded values, sums are pre-aggregated.

Defined results: a null text has no words and fails the base rule; null languages and sources are
groups of their own; repeated rows are judged each on its own; an empty table gives no rows.
Columns beyond identifier, text, language and source are kept by :func:`keep_good` alone, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.session import drop_staged, staged

WHITE = r"\x20\x09-\x0D"
#: Rows that a group needs for an estimate of its own.
MIN_GROUP = 50
#: Share of rows in the concentrated subset. Steps end when no determinant changes by more than
#: ``SETTLED`` of itself, or after ``STEPS``.
SUBSET = 0.75
SETTLED, STEPS = 0.01, 16
#: Units of the rounded vectors to one, and the least standard deviation of a component in units.
UNIT = 1024
FLOOR = 0.06 * UNIT
#: Characters at which a text's deviations are damped by the square root of one half.
DAMP = 400
#: Groups whose estimates are broadcast at most; beyond, estimates are joined with a salt.
BROADCAST_GROUPS = 20_000
SALTS = 16
#: Squared distance beyond which a row is an outlier, and the chi-squared median of 4 dimensions.
CUTOFF = 30.0
CHI2_MEDIAN = 3.3567
STATS = ("symbols", "upper", "marks", "length")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The word statistics of every row, with the columns named in ``keep``."""
    text = F.coalesce("_text", F.lit(""))
    d = docs.select(*keep, F.col("text").alias("_text"))
    d = d.withColumn("_words", F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != ""))
    d = d.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "_marks": F.regexp_count(text, F.lit(rf"[^\p{{L}}\p{{N}}{WHITE}]")),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]")),
        "_codes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    at = lambda k: F.get("_codes", k)
    windows = F.transform(F.sequence(F.lit(0), F.size("_codes") - 5), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4)))
    d = d.withColumns({
        "_windows": F.when(F.size("_codes") >= 5, windows).otherwise(F.array().cast("array<bigint>")),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    })
    d = d.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered()).otherwise(F.lit(0)).cast("bigint"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # the statistics pass through a generator, which keeps the optimiser from writing their long
    # expressions into every later use of a column
    made = ("n_words", "word_chars", "n_symbols", "_upper", "_marks", "n_dup_lines", "n_repeat_words", "base_failed")
    return d.select(*keep, F.inline(F.array(F.struct(*made))))


def _covered() -> Column:
    """Words within windows that occur twice or more: windows are sorted by hash, those with an
    equal neighbour kept, and the lengths of their union added up from left to right."""
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # sorting once: the sorted array is bound to a lambda variable
    twice = F.flatten(F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    steps = F.flatten(F.transform(F.array(places), lambda s: F.transform(s, lambda p, k: F.when(k == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(s, k - 1))))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _angle(count: str) -> Column:
    """Variance-stabilised share of a text's word characters, in units."""
    share = F.least(F.lit(1.0), F.col(count) / F.greatest(F.col("word_chars"), F.lit(1)))
    return F.floor(2 * F.asin(F.sqrt(share)) * UNIT + 0.5)


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "_symbols": _angle("n_symbols"),
        "_upper": _angle("_upper"),
        "_marks": _angle("_marks"),
        "_length": F.floor(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))) * UNIT / 2 + 0.5),
        "_damp": F.sqrt(F.col("word_chars") / (F.col("word_chars") + DAMP)),
        "_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")),
        "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")),
    })


def _with(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Join rows with their group's figures: broadcast behind a check of size, else salted."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), ["_lang", "_source"])
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["_lang", "_source", "_salt"]).drop("_salt")


def _deviations() -> list[Column]:
    return [F.floor((F.col(f"_{s}") - F.col(f"_m_{s}")) * F.col("_damp") + 0.5).cast("double") for s in STATS]


def _distance(centre: str = "_c") -> Column:
    """Squared Mahalanobis distance of the deviations ``_u*`` under ``_p*`` (precision matrix)."""
    v = [F.col(f"_u{i}") - F.col(f"{centre}{i}") for i in range(len(STATS))]
    terms = [F.col(f"_p{max(i, j)}{min(i, j)}") * v[i] * v[j] * (1 if i == j else 2) for i in range(len(STATS)) for j in range(i + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


def _precision(sums: DataFrame, *keys: str) -> DataFrame:
    """Centre, inverse scatter and determinant of the scatter of each group from its sums (Cholesky
    factor, then its inverse)."""
    k = range(len(STATS))
    d = sums.withColumns({f"_c{i}": F.col(f"_s{i}") / F.col("_n") for i in k})
    d = d.withColumns({f"_a{i}{j}": F.col(f"_q{i}{j}") / F.col("_n") - F.col(f"_c{i}") * F.col(f"_c{j}") + (FLOOR**2 if i == j else 0.0) for i in k for j in range(i + 1)})
    for j in k:
        under = lambda i: sum((F.col(f"_l{i}{m}") * F.col(f"_l{j}{m}") for m in range(j)), F.lit(0.0))  # noqa: B023, E731
        d = d.withColumn(f"_l{j}{j}", F.sqrt(F.col(f"_a{j}{j}") - under(j)))
        d = d.withColumns({f"_l{i}{j}": (F.col(f"_a{i}{j}") - under(i)) / F.col(f"_l{j}{j}") for i in k if i > j})
    for i in k:
        d = d.withColumns({f"_i{i}{j}": (F.lit(1.0) if i == j else -sum((F.col(f"_l{i}{m}") * F.col(f"_i{m}{j}") for m in range(j, i)), F.lit(0.0))) / F.col(f"_l{i}{i}") for j in range(i + 1)})
    precision = (sum((F.col(f"_i{m}{i}") * F.col(f"_i{m}{j}") for m in range(i, len(STATS))), F.lit(0.0)).alias(f"_p{i}{j}") for i in k for j in range(i + 1))
    det = reduce(lambda x, y: x * y, (F.col(f"_l{i}{i}") * F.col(f"_l{i}{i}") for i in k))
    return d.select(*keys, *(f"_c{i}" for i in k), *precision, det.alias("_det"))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    k = range(len(STATS))
    return rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("_n"), *([F.max("_det").alias("_old")] if "_det" in rows.columns else []),
        *(F.sum(f"_u{i}").alias(f"_s{i}") for i in k),
        *(F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")).alias(f"_q{i}{j}") for i in k for j in range(i + 1)),
    )


#: Squared distances are counted as rounded logarithms.
_LOG_D = 256.0


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """Group estimates ``_lang, _source, _m_*, _c*, _p*, _scale``, one row per (language, source).

    ``stats`` is a stored table of :func:`text_statistics`. Rows that fail the base rule take no
    part. Returns the estimates and their number.
    """
    rows = _vectors(stats.filter(~F.col("base_failed")))
    sizes = staged(rows.groupBy("_lang", "_source").agg(F.count("*").alias("_n")), "quality-sizes")
    n_groups = sizes.count()
    by_lang = sizes.groupBy("_lang").agg(F.sum("_n").alias("_n_lang"))
    star = F.lit("*")
    # the group that each pair takes its estimate from
    target = sizes.join(by_lang, "_lang").select(
        "_lang", "_source",
        F.when((F.col("_n") >= MIN_GROUP) | (F.col("_n_lang") >= MIN_GROUP), F.col("_lang")).otherwise(star).alias("_to_lang"),
        F.when(F.col("_n") >= MIN_GROUP, F.col("_source")).otherwise(star).alias("_to_source"),
    )
    needed = target.select(F.col("_to_lang").alias("_l"), F.col("_to_source").alias("_s")).distinct()
    # the estimates that each pair's rows take part in: mostly their own alone
    every = F.explode(F.array(F.struct(F.col("_lang").alias("_l"), F.col("_source").alias("_s")), F.struct(F.col("_lang").alias("_l"), star.alias("_s")), F.struct(star.alias("_l"), star.alias("_s"))))
    parts = sizes.select("_lang", "_source", every.alias("_g")).select("_lang", "_source", "_g.*").join(needed, ["_l", "_s"])
    parts = staged(parts.groupBy("_lang", "_source").agg(F.collect_list(F.struct("_l", "_s")).alias("_groups")), "quality-parts")
    members = _with(rows.select("_row", "_lang", "_source", *(f"_{s}" for s in STATS), "_damp"), parts, n_groups)
    members = members.withColumn("_g", F.explode("_groups")).select("_row", *(f"_{s}" for s in STATS), "_damp", F.col("_g._l").alias("_lang"), F.col("_g._s").alias("_source"))
    medians = staged(members.groupBy("_lang", "_source").agg(*(F.floor(F.percentile(f"_{s}", 0.5)).alias(f"_m_{s}") for s in STATS)), "quality-medians")
    k = range(len(STATS))
    us = dict(zip((f"_u{i}" for i in k), _deviations(), strict=True))
    points = staged(_with(members, medians, n_groups).withColumns(us).select("_row", "_lang", "_source", *us), "quality-points")
    model = staged(_starts(points, n_groups), "quality-model0")
    rounded = F.floor(F.log1p(_distance()) * _LOG_D).cast("int")
    keys = ("_lang", "_source", "_start")
    for step in range(STEPS):
        away = _with(points, model, n_groups).withColumn("_d", rounded)
        limit = away.groupBy(*keys).agg(F.percentile("_d", SUBSET).alias("_limit"))
        near = _with(points, model.join(limit, [*keys]), n_groups).withColumn("_d", rounded).filter(F.col("_d") <= F.col("_limit"))
        new = _precision(_sums(near, *keys), *keys, "_old").withColumn("_moved", F.abs(F.col("_det") / F.col("_old") - 1)).drop("_old")
        new = staged(new, f"quality-model{step + 1}")
        moved = new.agg(F.max("_moved")).first()[0]
        drop_staged(model)
        model = new
        if moved is None or moved <= SETTLED:
            break
    best = F.min(F.struct("_det", "_start", *(f"_c{i}" for i in k), *(f"_p{i}{j}" for i in k for j in range(i + 1)))).alias("_best")
    model = staged(model.groupBy("_lang", "_source").agg(best).select("_lang", "_source", "_best.*").drop("_start"), "quality-model")
    middle = _with(points, model, n_groups).withColumn("_d", rounded).groupBy("_lang", "_source").agg((F.expm1((F.percentile("_d", 0.5) + 0.5) / _LOG_D) / CHI2_MEDIAN).alias("_scale"))
    whole = model.join(middle, ["_lang", "_source"]).join(medians, ["_lang", "_source"])
    renamed = whole.withColumnsRenamed({"_lang": "_to_lang", "_source": "_to_source"})
    return staged(target.join(renamed, ["_to_lang", "_to_source"]).drop("_to_lang", "_to_source"), "quality-estimates"), n_groups


def _starts(points: DataFrame, n_groups: int) -> DataFrame:
    """``_lang, _source, _start``, centre, inverse scatter and determinant of the three starts."""
    k = range(len(STATS))
    spread = staged(points.groupBy("_lang", "_source").agg(*((F.percentile(F.abs(f"_u{i}"), 0.5) * 1.4826 + FLOOR).alias(f"_d{i}") for i in k)), "quality-spread")
    square = lambda i: F.col(f"_d{i}") * F.col(f"_d{i}")
    medians = spread.select(
        "_lang", "_source", F.lit(0).alias("_start"), *(F.lit(0.0).alias(f"_c{i}") for i in k),
        *((1 / square(i) if i == j else F.lit(0.0)).alias(f"_p{i}{j}") for i in k for j in range(i + 1)), reduce(lambda x, y: x * y, map(square, k)).alias("_det"),
    )
    keys = ("_lang", "_source", "_start")
    whole = points.withColumn("_start", F.lit(1))
    damped = _with(points, spread, n_groups).withColumns({f"_u{i}": F.floor(F.tanh(F.col(f"_u{i}") / F.col(f"_d{i}")) * F.col(f"_d{i}") + 0.5) for i in k}).withColumn("_start", F.lit(2))
    return medians.unionByName(_precision(_sums(whole, *keys), *keys)).unionByName(_precision(_sums(damped, *keys), *keys))


def judge(stats: DataFrame, estimates: DataFrame, n_groups: int, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with ``distance`` (null where the base rule failed) and ``kept``."""
    rows = _vectors(stats)
    own = [c for c in stats.columns if not c.startswith("_")]
    if n_groups <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(estimates), ["_lang", "_source"], "left")
    else:
        salted = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["_lang", "_source", "_salt"], "left")
    joined = joined.withColumns(dict(zip((f"_u{i}" for i in range(len(STATS))), _deviations(), strict=True)))
    joined = joined.withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.greatest(F.col("_scale"), F.lit(1.0))))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).select(*own, "distance", "kept")


def quality_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The statistics of all rows as a stored table, with ``keep`` and a ``document`` of all columns
    if that is among them; no text otherwise."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    own = whole.select("document", *(F.col(f"document.{c}").alias(c) for c in ("doc_id", "text", "lang", "source")), F.xxhash64("document.doc_id").alias("_row"))
    return staged(text_statistics(own, *keep, "lang", "source", "_row"), "quality-stats")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id, lang, source`` and the statistics of every row, with ``distance`` and ``kept``."""
    stats = quality_statistics(docs, "doc_id")
    estimates, n = fit(stats)
    return judge(stats, estimates, n, cutoff)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. They are stored beside
    their statistics meanwhile, as these cost more than the writing."""
    stats = quality_statistics(docs, "document")
    estimates, n = fit(stats)
    return judge(stats, estimates, n, cutoff).filter("kept").select("document.*")
