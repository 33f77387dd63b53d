"""The line rules as column expressions: logs, traces, tables and code are rewritten in the JVM.

Each text is an array of lines; runs and groups are found from sorted positions, so the work is linear
in the lines but for sorting. :mod:`brevis.functions.rewriting` holds the patterns and says the same
rules line by line, which tests hold against these.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevis.functions import rewriting as R
from brevis.functions.text import SPACE, lines

_DELIMITERS = ("\t", "|", ",")
_RULE_ROW = rf"^[{SPACE}|:.-]*-[{SPACE}|:.-]*$"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def in_java(pattern: re.Pattern | str) -> str:
    """A pattern of Python's (ASCII words, line feeds alone end lines) as one of Java's."""
    body, flags = (pattern, 0) if isinstance(pattern, str) else (pattern.pattern, pattern.flags)
    return "(?d" + "i" * bool(flags & re.I) + "m" * bool(flags & re.M) + "s" * bool(flags & re.S) + ")" + body.replace(r"\b", _EDGE)


def _has(line: Column, pattern: re.Pattern | str) -> Column:
    return line.rlike(in_java(pattern))


def bound(x: Column, use) -> Column:  # noqa: ANN001
    """``use(x)`` with ``x`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _agreed_count(counts: Column, n_rows: Column) -> Column:
    """The count that most rows agree on, or null.

    A count that six tenths of the counted rows share is the middle one of the sorted counts.
    """
    def agreed(counts: Column) -> Column:
        usual = F.get(counts, F.floor(F.size(counts) / 2).cast("int"))
        agree = F.size(F.filter(counts, lambda n: n == usual))
        return F.when((F.size(counts) >= F.greatest(F.lit(2.0), n_rows * 0.6)) & (agree >= F.size(counts) * 0.6), usual)

    return bound(F.sort_array(counts), agreed)


def delimiter_of(rows: Column) -> Column:
    """struct(delimiter, columns) of non-blank rows, or null."""
    def counted(plain: Column) -> Column:
        found = F.lit(None).cast("struct<delimiter:string,columns:int>")
        for mark in reversed(_DELIMITERS):
            counts = F.filter(F.transform(plain, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))), lambda n: n > 0)  # noqa: B023
            usual = _agreed_count(counts, F.size(rows))
            found = F.coalesce(F.get(F.transform(F.filter(F.array(usual), lambda n: n.isNotNull()), lambda n: F.struct(F.lit(mark).alias("delimiter"), (n + 1).cast("int").alias("columns"))), F.lit(0)), found)  # noqa: B023
        return found

    return bound(F.filter(rows, lambda x: ~x.rlike(_RULE_ROW)), counted)


def full_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x.rlike(f"[^{SPACE}]"))


def pick_delimiter(text: str | Column) -> Column:
    """struct(delimiter, columns) that most of a text's lines agree on, or null: tab, bar or comma."""
    c = F.col(text) if isinstance(text, str) else text
    return bound(full_lines(c), delimiter_of)


def log_template(line: str | Column) -> Column:
    """A log line with times, numbers and hashes named by kind."""
    c = F.col(line) if isinstance(line, str) else line
    for pattern, name in R.TEMPLATE:
        c = F.regexp_replace(c, in_java(pattern), name)
    return c


def _numbered(items: Column) -> Column:
    """struct(i, x) of every item, from 0."""
    return F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def _gaps(places: Column) -> Column:
    """How many places lie between each of ascending ``places`` and the one before it."""
    return F.transform(places, lambda p, k: p - F.coalesce(F.get(places, k - 1), F.lit(-1)) - 1)


def _told(parts: Column) -> Column:
    """Lines of struct(at, part, line) in order."""
    return F.array_join(F.transform(F.sort_array(parts), lambda x: x["line"]), "\n")


_PART = "array<struct<at:int,part:int,line:string>>"


def rewrite_log(text: Column, level: str = "safe") -> Column:
    telling = lambda x: _has(x, R._ALARM) | _has(x, R._STACK)
    filled = lambda x: x.rlike(f"[^{SPACE}]")

    def counted(every: Column) -> Column:
        n = F.size(F.filter(every, lambda x: ~telling(x) & filled(x)))
        kept = F.filter(every, telling)
        return F.array_join(F.concat(kept, F.when(n > 0, F.array(F.concat(F.lit("("), n.cast("string"), F.lit(" routine log lines omitted)")))).otherwise(F.array().cast("array<string>"))), "\n")

    def grouped(every: Column) -> Column:
        marked = F.transform(_numbered(every), lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"), telling(x["x"]).alias("told")))
        return bound(marked, parts)

    def parts(marked: Column) -> Column:
        kept = F.transform(F.filter(marked, lambda x: x["told"]), lambda x: F.struct(x["i"].alias("at"), F.lit(0).alias("part"), x["x"].alias("line")))
        routine = F.transform(F.filter(marked, lambda x: ~x["told"] & filled(x["x"])), lambda x: F.struct(log_template(x["x"]).alias("t"), x["i"].alias("i"), x["x"].alias("x")))
        return _told(F.concat(kept, bound(F.sort_array(routine), groups)))

    def groups(ordered: Column) -> Column:
        """Of each template the first line, counted and with numbers as ``#`` where there are several."""
        first = F.filter(F.transform(ordered, lambda x, k: F.when((k == 0) | (F.get(ordered, k - 1)["t"] != x["t"]), k)), lambda k: k.isNotNull())

        def line(starts: Column) -> Column:
            def of(k: Column, j: Column) -> Column:
                own, n = F.get(ordered, k), F.coalesce(F.get(starts, j + 1), F.size(ordered)) - k
                plain = F.regexp_replace(own["x"], in_java(f"^[{SPACE}]*{R.TIME}[{SPACE}]*"), "")
                general = F.concat(n.cast("string"), F.lit("× "), F.regexp_replace(plain, in_java(R._NUMBER), "#"))
                return F.struct(own["i"].alias("at"), F.lit(0).alias("part"), F.when(n == 1, own["x"]).otherwise(general).alias("line"))

            return F.transform(starts, of)

        return bound(first, line)

    return bound(lines(text), counted if level == "aggressive" else grouped)


def rewrite_table(text: Column, level: str = "safe") -> Column:
    shown = 2 if level == "aggressive" else 4

    def cut(rows: Column) -> Column:
        odd = F.slice(F.filter(F.slice(rows, shown + 1, F.greatest(F.size(rows) - shown, F.lit(0))), lambda x: _has(x, R._ODD_ROW)), 1, 3)
        return bound(odd, lambda found: _listed(rows, found))

    def _listed(rows: Column, odd: Column) -> Column:
        hidden = F.size(rows) - F.least(F.size(rows), F.lit(shown)) - F.size(odd)
        note = F.when(hidden > 0, F.array(F.concat(F.lit("… "), hidden.cast("string"), F.lit(" more rows …")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.slice(rows, 1, shown), odd, note), "\n")

    def table(full: Column) -> Column:
        rows = F.filter(full, lambda x: ~_has(x, R._RULE_ROW))
        return bound(rows, lambda r: F.when((F.size(r) >= 3) & delimiter_of(full).isNotNull(), cut(r)).otherwise(text))

    return bound(full_lines(text), table)


def rewrite_trace(text: Column, level: str = "safe") -> Column:
    """Library frames are counted before the next other line, passed tests before the next failure or
    summary, and what is left of both at the end."""

    def mark(x: Column, i: Column) -> Column:
        frame, passed = _has(x, R._FRAME), _has(x, R._PASSED)
        other = F.lit("talk") if level == "safe" else F.when(_has(x, R._CONTEXT), "talk").otherwise("drop")
        return (
            F.when(frame, F.when(_has(x, R._LIBRARY), "library").otherwise("own"))
            .when((i == 0) & ~passed, "head").when(_has(x, R._FAILED), "news").when(passed, "pass").when(_has(x, R._SUMMARY), "news").otherwise(other)
        )

    def note(n: Column, kind: str) -> Column:
        s = F.when(n == 1, "").otherwise("s")
        return F.concat(F.lit("    … "), n.cast("string"), F.lit(" library frame"), s, F.lit(" …")) if kind == "library" else F.concat(F.lit("("), n.cast("string"), F.lit(" passing test"), s, F.lit(")"))

    def counts(places: Column, ends: Column, part: int, kind: str) -> Column:
        """Notes at each of ``ends`` (line numbers) for the gaps before ``places``."""
        noted = F.transform(_gaps(places), lambda n, k: F.struct(F.get(ends, k).alias("at"), F.lit(part).alias("part"), F.when(n > 0, note(n, kind)).alias("line")))
        return F.filter(noted, lambda x: x["line"].isNotNull())

    def told(marked: Column) -> Column:
        size = F.size(marked)
        lines_of = lambda keep: F.transform(F.filter(marked, keep), lambda x: x["i"])
        # the lines that end a run of library frames, and a last one after all
        others = F.concat(lines_of(lambda x: x["mark"] != "library"), F.array(size))
        # news among news and passes, as places in that row and as lines
        row = F.filter(marked, lambda x: x["mark"].isin("news", "pass"))
        news = bound(row, lambda r: F.concat(F.transform(F.filter(_numbered(r), lambda x: x["x"]["mark"] == "news"), lambda x: F.struct(x["i"].alias("place"), x["x"]["i"].alias("line"))), F.array(F.struct(F.size(r).alias("place"), size.alias("line")))))
        kept = F.transform(F.filter(marked, lambda x: ~x["mark"].isin("library", "pass", "drop")), lambda x: F.struct(x["i"].alias("at"), F.lit(2).alias("part"), x["x"].alias("line")))
        frames = bound(others, lambda o: counts(o, o, 0, "library"))
        tests = bound(news, lambda w: counts(F.transform(w, lambda x: x["place"]), F.transform(w, lambda x: x["line"]), 1, "pass"))
        return _told(F.concat(kept.cast(_PART), frames.cast(_PART), tests.cast(_PART)))

    marked = lambda found: F.transform(_numbered(found), lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"), mark(x["x"], x["i"]).alias("mark")))
    return bound(full_lines(text), lambda found: bound(marked(found), told))


def rewrite_code(text: Column, level: str = "safe") -> Column:
    for pattern, by, flags in R._CODE_STEPS:
        text = F.regexp_replace(text, in_java(re.compile(pattern, flags)), by.replace(r"\1", "$1"))
    if level == "aggressive":
        text = F.regexp_replace(text, f"(?md)^[{SPACE}]*\\n", "")
        half = lambda x: F.concat(F.repeat(F.lit(" "), F.ceil((F.length(x) - F.length(F.ltrim(x, F.lit(" \t")))) / 2).cast("int")), F.ltrim(x, F.lit(" \t")))
        text = F.array_join(F.transform(F.split(text, "\n"), half), "\n")
    else:
        text = F.regexp_replace(text, "\\n{3,}", "\n\n")
    return F.regexp_replace(text, f"^[{SPACE}]+|(?d)[{SPACE}]+$", "")


RULES = {"log": rewrite_log, "trace": rewrite_trace, "table": rewrite_table, "code": rewrite_code}
