"""Content detection, compression and the reversible store over columns of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from brevis.functions import line_rules, rewriting
from brevis.functions.line_rules import bound, delimiter_of, full_lines
from brevis.functions.text import SPACE, base36, estimate_tokens, lines, saving, trimmed
from brevis.session import ship_package

MARK = "brevis"
HANDLE = "ccr_[a-z0-9]+"
#: Characters of an original that a retrieval returns at most, unless another limit is given.
RETRIEVE_LIMIT = 100_000
KEEP_RANGE = (0.05, 1.0)
#: A token counter: a column of texts to a column of counts.
Counter = Callable[[Column], Column]

# ---- fixed values: patterns of content types ----
_WORD, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_CALL_FRAME = rf"(?md)^[{SPACE}]*at[{SPACE}]+.+:[0-9]+:[0-9]+"
_FILE_FRAME = rf'(?md)^[{SPACE}]*File ".*", line [0-9]+'
_TRACEBACK = "Traceback (most recent call last)"
_TEST_MARK = rf"[✗✕✘✖✓✔]|{_WORD}PASS{_END}|{_WORD}FAIL(?:ED)?{_END}|{_WORD}not ok [0-9]+|{_WORD}[0-9]+ (?:passing|failing|passed|failed){_END}"
#: What a text without any of these, or of the marks, need not be searched for.
_TEST_WORDS = ("PASS", "FAIL", "not ok ", " passing", " failing", " passed", " failed")
_LOG_LINE = (
    f"(?i){_WORD}(?:error|warn|warning|info|debug|trace|fatal|critical){_END}",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]",
    rf"^[{SPACE}]+at[{SPACE}]",
    r"^\[[0-9]",
)
_CODE_MARK = f"[{{}}();]|=>|{_WORD}(?:function|const|let|def|class|import|export|return|public|private|fn|func){_END}"
# -------------------------------------------------


def _is_json(text: Column) -> Column:
    """Whether a text is strict JSON; null is not. The package is shipped to the workers first."""
    ship_package(SparkSession.active())

    @F.pandas_udf(BooleanType())
    def check(texts: pd.Series) -> pd.Series:
        def ok(x: str | None) -> bool:
            try:
                rewriting.parse_json(x or "")
            except ValueError:
                return False
            return True

        return texts.map(ok).astype(bool)

    return check(text)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_type(text: str | Column) -> Column:
    """Content type of a text: json, trace, table, log, code or prose; the first that fits.

    All tests but strict JSON parsing are built-in functions; only texts within brackets are
    parsed.
    """
    t = trimmed(text)
    bracketed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.when(bracketed & _is_json(F.when(bracketed, t)), "json").otherwise(bound(t, _type_of_trimmed))


def _test_marks(t: Column) -> Column:
    """How many marks of test output a text holds; most texts hold none of their words."""
    may = reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in _TEST_WORDS)) | t.rlike("[✓-✘]")
    return F.when(may, _matches(t, _TEST_MARK)).otherwise(0)


def _type_of_trimmed(t: Column) -> Column:
    def logged(every: Column) -> Column:
        hit = F.filter(every, lambda x: reduce(lambda a, b: a | b, (x.rlike(p) for p in _LOG_LINE)))
        return (F.size(every) >= 4) & (F.size(hit) / F.size(every) >= 0.3)

    return (
        F.when((_matches(t, _CALL_FRAME) >= 2) | (_matches(t, _FILE_FRAME) >= 2) | t.contains(_TRACEBACK) | (_test_marks(t) >= 3), "trace")
        .when(bound(full_lines(t), lambda rows: (F.size(rows) >= 3) & delimiter_of(rows).isNotNull()), "table")
        .when(bound(lines(t), logged), "log")
        .when(_matches(t, _CODE_MARK) >= F.greatest(F.lit(8.0), F.length(t) / 80), "code")
        .otherwise("prose")
    )


def marker(handle: Column, name: str = MARK) -> Column:
    return F.concat(F.lit(f"«{name}:retrieve "), handle, F.lit("»"))


def handle_of(key: str | Column) -> Column:
    """A store handle made from a row's key, the same however often it is made."""
    return F.concat(F.lit("ccr_"), base36(key))


def compress_content(df: DataFrame, text: str = "text", level: str = "safe", kind: str | None = None, keep: float | None = None, key: str | None = None, count: Counter = estimate_tokens) -> DataFrame:
    """``df`` with ``type, compressed, original_tokens, compressed_tokens, ratio, saved`` and, with
    ``key``, a ``handle`` whose marker is appended. Null texts count as empty; ``count`` counts the
    tokens of a text."""
    if level not in rewriting.LEVELS or kind not in (None, *rewriting.TYPES):
        raise ValueError(f"unknown level or type: {level}, {kind}")
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        prose = kinds == "prose"
        rewritten = rewriting.rewrite_proses(texts[prose].tolist(), rewriting.prose_keep(level, keep))
        out = pd.Series([None if k is None or p else rewriting.rewrite(t, k, level) for t, k, p in zip(texts, kinds, prose, strict=True)], dtype=object)
        out[prose.to_numpy()] = list(rewritten)
        return out

    source = F.coalesce(F.col(text), F.lit(""))
    # a generator parts the two Python stages: the type is made once, before texts are rewritten
    typed = df.withColumn("type", F.lit(kind)) if kind else df.select("*", F.explode(F.array(detect_type(source))).alias("type"))
    rules = [k for k in line_rules.RULES if kind in (None, k)]
    if kind in line_rules.RULES:
        out = typed.withColumn("compressed", line_rules.RULES[kind](source, level))
    else:
        # only prose and JSON go through Python
        own = F.col("type").isin("prose", "json")
        made = run(F.when(own, source), F.when(own, F.col("type")))
        for k in rules:
            made = F.when(F.col("type") == k, line_rules.RULES[k](source, level)).otherwise(made)
        out = typed.withColumn("compressed", made)
    if key:
        out = out.withColumn("handle", handle_of(key)).withColumn("compressed", F.concat("compressed", F.lit("\n"), marker(F.col("handle"))))
    out = out.withColumns({"original_tokens": count(source), "compressed_tokens": count(F.col("compressed"))})
    ratio, saved = saving("original_tokens", "compressed_tokens")
    return out.withColumns({"ratio": ratio, "saved": saved})


def store(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``handle, original``: the reversible store of a table, one row per row."""
    return df.select(handle_of(key).alias("handle"), F.col(text).alias("original"))


def retrieve(handles: DataFrame, originals: DataFrame, limit: int | None = None) -> DataFrame:
    """``handles`` with ``original`` (null if unknown), ``length`` and ``truncated``."""
    out = handles.join(originals, "handle", "left").withColumn("length", F.length("original"))
    if limit is None:
        return out.withColumn("truncated", F.lit(False))
    cut = F.col("length") > limit
    note = F.concat(F.substring("original", 1, limit), F.lit("\n… truncated, "), F.col("length").cast("string"), F.lit(" characters in all"))
    return out.withColumns({"original": F.when(cut, note).otherwise(F.col("original")), "truncated": F.coalesce(cut, F.lit(False))})


def compress_tool(calls: DataFrame, key: str, text: str = "content", level: str = "safe", kind: str = "auto", keep: float | None = None, count: Counter = estimate_tokens) -> DataFrame:
    """The compression tool over a table of calls: as :func:`compress_content`, always with a handle.

    A call without content has an ``error`` and no result; an unknown type or level, or a share to
    keep outside ``KEEP_RANGE``, is refused for all calls."""
    if keep is not None and not KEEP_RANGE[0] <= keep <= KEEP_RANGE[1]:
        raise ValueError(f"keep: from {KEEP_RANGE[0]} to {KEEP_RANGE[1]}")
    out = compress_content(calls, text, level, None if kind == "auto" else kind, keep, key, count)
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    made = ("type", "compressed", "original_tokens", "compressed_tokens", "ratio", "saved", "handle")
    return out.withColumns({c: F.when(~empty, F.col(c)) for c in made}).withColumn("error", F.when(empty, "content must not be empty"))


def retrieve_tool(calls: DataFrame, originals: DataFrame, limit: int = RETRIEVE_LIMIT) -> DataFrame:
    """The retrieval tool over a table of calls (``handle``): :func:`retrieve` with an ``error``."""
    found = retrieve(calls, originals.withColumn("_known", F.lit(True)), limit)
    error = F.when(~F.coalesce(F.col("handle").rlike(f"^{HANDLE}$"), F.lit(False)), "a handle is ccr_ and letters or digits").when(F.col("_known").isNull(), "unknown handle")
    return found.withColumn("error", error).drop("_known")


def prune_with_model(df: DataFrame, make_scorer: Callable[[], rewriting.Scorer], keep: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` with ``pruned``: the least predictable share of each text's tokens under a language
    model. ``make_scorer`` loads the model once in every task. Null texts count as empty."""
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for texts in batches:
            yield texts.map(lambda t: rewriting.prune_by_surprisal(t or "", scorer, keep))

    return df.withColumn("pruned", run(F.coalesce(F.col(text), F.lit(""))))


def signal_recall(df: DataFrame, compressed: str, markers: str) -> DataFrame:
    """``df`` with ``n_markers`` and ``n_surviving``: how many of a row's marker texts (an array) its
    compressed text still holds."""
    kept = F.filter(markers, lambda m: F.contains(F.col(compressed), m))
    return df.withColumns({"n_markers": F.size(markers).cast("bigint"), "n_surviving": F.size(kept).cast("bigint")})


def retrieve_all(df: DataFrame, compressed: str, originals: DataFrame, *keys: str) -> DataFrame:
    """The known handles that each text names, once each, with their originals."""
    named = df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(compressed, F.lit(f"«{MARK}:retrieve ({HANDLE})»"), 1))).alias("handle"))
    return named.join(originals, "handle")


def session_stats(calls: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row: calls, tokens in, out and saved, the share saved, and the number of originals."""
    total = calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("tokens_out"))
    total = total.withColumns({"tokens_saved": F.col("tokens_in") - F.col("tokens_out"), "saved": saving("tokens_in", "tokens_out")[1]})
    # one row on either side
    return total if originals is None else total.join(originals.agg(F.count("*").alias("stored")), F.lit(True))
