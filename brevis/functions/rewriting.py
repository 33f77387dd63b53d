"""Rewriting of one text by content type: what the compression operator runs per row.

A text is rewritten where it is read, so no line or token is ever shuffled. Regular expressions
are ASCII for words and digits and use the shared white-space class.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np

from brevis.functions.text import SPACE

_S = f"[{SPACE}]"
LEVELS = ("safe", "aggressive")
TYPES = ("json", "log", "code", "prose", "trace", "table")

# ---- fixed values: word lists and line patterns of the rules ----
_ALARM = re.compile(r"\b(?:error|err|fatal|critical|crit|exception|traceback|panic|fail(?:ed|ure)?|warn(?:ing)?|assert(?:ion)?)\b", re.I | re.A)
_STACK = re.compile(rf'^{_S}+at{_S}|^{_S}+File{_S}"|^Traceback|^{_S}+\.\.\.')
TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.,]+Z?"
_NUMBER = re.compile(r"\b[0-9]+(?:\.[0-9]+)?\b", re.A)
TEMPLATE = ((TIME, "<ts>"), (_NUMBER, "<n>"), (r"0x[0-9a-fA-F]+", "<hex>"), (re.compile(r"\b[0-9a-f]{8,}\b", re.I | re.A), "<hash>"))
_ODD_ITEM = re.compile(r"error|fail|exception|warn|null|missing|invalid", re.I | re.A)
_FRAME = re.compile(rf'^{_S}*(?:at{_S}|File{_S}")')
_LIBRARY = re.compile(r"node_modules|site-packages|[\\/]dist[\\/]|internal[\\/]|\(node:|<anonymous>|[\\/]usr[\\/]lib|runtime/|\.pyenv|dist-packages", re.I | re.A)
_FAILED = re.compile(r"✗|✕|✘|×|✖|●|\bFAIL(?:ED)?\b|\bnot ok\b|\w*Error\b|\w*Exception\b|Traceback", re.A)
_PASSED = re.compile(rf"^{_S}*(?:✓|✔|√|PASS\b|ok{_S}+[0-9]+\b)", re.A)
_SUMMARY = re.compile(rf"\b[0-9]+{_S}+(?:passing|failing|passed|failed|skipped|pending)\b|Tests?:{_S}|Test Suites?:{_S}", re.I | re.A)
_CONTEXT = re.compile(rf"expected|received|assert|caused by|^{_S}*[-+>]|=>|diff|line{_S}+[0-9]+", re.I | re.A)
_ODD_ROW = re.compile(rf"\b(?:error|null|nan|none|missing|undefined|fail(?:ed)?|invalid|timeout)\b|,,|\|{_S}*\||^{_S}*,|,{_S}*$", re.I | re.A)
_RULE_ROW = re.compile(rf"^[{SPACE}|:.-]*-[{SPACE}|:.-]*$")
_CODE_STEPS = ((r"/\*.*?\*/", "", re.S), (r"([^:\"'`])//[^\n]*", r"\1", 0), (rf"^{_S}*#[^\n]*$", "", re.M), (r"[ \t]+$", "", re.M))
_NAME_MARK = re.compile(r"[_/.\\{}()=<>:#@\[\]]")
STOPWORDS = (
    "a an the of to in on at for and or but nor so yet is are was were be been being am it its this that these those with as by from into onto "
    "than then there here i you he she they we us them him her my your his their our me do does did has have had will would shall can could should "
    "may might must not no yes just very really quite too also about over under again more most some any all each every"
)
# ----------------------------------------------------------------
_STOPWORDS = frozenset(STOPWORDS.split())
_WORD, _NOT_BARE, _DIGIT = re.compile(f"[^{SPACE}]+"), re.compile("[^a-z0-9]"), re.compile("[0-9]")


def _lines(text: str) -> list[str]:
    return re.split(r"\r?\n", text)


def _blank(line: str) -> bool:
    return re.fullmatch(f"{_S}*", line) is not None


def log_template(line: str) -> str:
    """A line with times, numbers and hashes named by kind."""
    for pattern, name in TEMPLATE:
        line = re.sub(pattern, name, line)
    return line


def rewrite_log(text: str, level: str = "safe") -> str:
    """Alarms and stack lines stay; other lines are counted, by template at level ``safe``."""
    lines = _lines(text)
    telling = [bool(_ALARM.search(x) or _STACK.search(x)) for x in lines]
    routine = [i for i, x in enumerate(lines) if not telling[i] and not _blank(x)]
    kept = {i: lines[i] for i, t in enumerate(telling) if t}
    if level == "aggressive":
        out = list(kept.values())
        return "\n".join([*out, f"({len(routine)} routine log lines omitted)"] if routine else out)
    first: dict[str, int] = {}
    times: Counter = Counter()
    for i in routine:
        times[first.setdefault(log_template(lines[i]), i)] += 1
    for i, n in times.items():
        general = _NUMBER.sub("#", re.sub(rf"^{_S}*{TIME}{_S}*", "", lines[i]))
        kept[i] = lines[i] if n == 1 else f"{n}× {general}"
    return "\n".join(kept[i] for i in sorted(kept))


class _NotJson(ValueError):
    pass


def _reject(name: str) -> None:
    raise _NotJson(name)


def _ordered(pairs: list[tuple[str, object]]) -> dict:
    """The last of equal keys wins; keys that are array indexes come first, ascending."""
    found = dict(pairs)
    index = [k for k in found if re.fullmatch("0|[1-9][0-9]{0,9}", k) and int(k) < 4294967295]
    return {k: found[k] for k in [*sorted(index, key=int), *(k for k in found if k not in set(index))]}


def parse_json(text: str) -> object:
    """Strict parsing; numbers are doubles. Raises ValueError."""
    try:
        return json.loads(text.strip(" \t\r\n"), parse_constant=_reject, parse_int=float, object_pairs_hook=_ordered)
    except RecursionError as e:
        raise _NotJson("too deep") from e


def _number(x: float) -> str:
    """The shortest decimal form, plain between 1e-7 and 1e21."""
    if math.isinf(x) or math.isnan(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    if -6 < point <= 0:
        out = "0." + "0" * -point + digits
    elif 0 < point < len(digits):
        out = f"{digits[:point]}.{digits[point:]}"
    else:
        e = point - 1
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" + out if x < 0 else out


def dump_json(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump_json, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def rewrite_json(text: str, level: str = "safe", sample: int = 2, max_string: int = 200) -> str:
    """Long arrays become a sample, up to three odd items and a note; long strings are clipped."""
    try:
        data = parse_json(text)
    except ValueError:
        return text
    folded = level == "aggressive"
    if folded:
        sample, max_string = 0, 80

    def shrink(v: object) -> object:
        if isinstance(v, dict):
            return {k: shrink(x) for k, x in v.items()}
        if isinstance(v, str) and _units(v) > max_string:
            head = v.encode("utf-16-le", "surrogatepass")[: 2 * max_string].decode("utf-16-le", "replace")
            return f"{head}…({_units(v)} chars)"
        if not isinstance(v, list) or len(v) <= sample + 1:
            return [shrink(x) for x in v] if isinstance(v, list) else v
        odd = [x for x in v[sample:] if _ODD_ITEM.search(dump_json(x))][:3]
        hidden = len(v) - sample - len(odd)
        note = f"…({hidden} more similar items)"
        if folded and hidden:
            shape = next((x for x in v if isinstance(x, dict)), None)
            note = f"…({hidden}× {'items' if shape is None else '{' + ','.join(shape) + '}'})"
        return [*map(shrink, v[:sample] + odd), note]

    return dump_json(shrink(data))


def rewrite_code(text: str, level: str = "safe") -> str:
    """Comments and needless blanks go. The rules work on text and do not know strings."""
    steps = list(_CODE_STEPS)
    if level == "aggressive":
        steps += [(rf"^{_S}*\n", "", re.M), (r"^[ \t]+", lambda m: " " * -(-len(m.group()) // 2), re.M)]
    else:
        steps += [(r"\n{3,}", "\n\n", 0)]
    for pattern, by, flags in steps:
        text = re.sub(pattern, by, text, flags=flags)
    return re.sub(rf"^{_S}+|{_S}+$", "", text)


def rewrite_trace(text: str, level: str = "safe") -> str:
    """Library frames and passed tests become counts; failures, own frames and summaries stay."""
    found = [x for x in _lines(text) if not _blank(x)]
    marks = []
    for i, line in enumerate(found):
        frame, passed = bool(_FRAME.search(line)), bool(_PASSED.search(line))
        if frame:
            marks.append("library" if _LIBRARY.search(line) else "own")
        elif i == 0 and not passed:
            marks.append("head")
        elif _FAILED.search(line):
            marks.append("news")
        elif passed:
            marks.append("pass")
        elif _SUMMARY.search(line):
            marks.append("news")
        else:
            marks.append("talk" if level == "safe" or _CONTEXT.search(line) else "drop")
    out: list[str] = []
    waiting = Counter()

    def report(kind: str) -> None:
        n = waiting.pop(kind, 0)
        s = "" if n == 1 else "s"
        if n:
            out.append(f"    … {n} library frame{s} …" if kind == "library" else f"({n} passing test{s})")

    for line, mark in zip(found, marks, strict=True):
        if mark == "library":
            waiting[mark] += 1
            continue
        if mark != "head":
            report("library")
        if mark == "pass":
            waiting[mark] += 1
            continue
        if mark == "news":
            report("pass")
        if mark != "drop":
            out.append(line)
    report("library")
    report("pass")
    return "\n".join(out)


def pick_delimiter(rows: list[str]) -> tuple[str, int] | None:
    """(delimiter, columns) that most rows agree on, or None. Rule rows count as rows only."""
    for mark in ("\t", "|", ","):
        counts = [n for x in rows if not _RULE_ROW.search(x) and (n := x.count(mark))]
        if len(counts) < max(2, 0.6 * len(rows)):
            continue
        usual, times = Counter(counts).most_common(1)[0]
        if times >= 0.6 * len(counts):
            return mark, usual + 1
    return None


def rewrite_table(text: str, level: str = "safe") -> str:
    """Header, first rows and up to three odd rows, and a count of the others."""
    full = [x for x in _lines(text) if not _blank(x)]
    rows = [x for x in full if not _RULE_ROW.search(x)]
    if len(rows) < 3 or pick_delimiter(full) is None:
        return text
    shown = 2 if level == "aggressive" else 4
    odd = [x for x in rows[shown:] if _ODD_ROW.search(x)][:3]
    hidden = len(rows) - len(rows[:shown]) - len(odd)
    return "\n".join([*rows[:shown], *odd, *([f"… {hidden} more rows …"] if hidden else [])])


#: Words whose worth is remembered by a worker.
_REMEMBERED = 1 << 17


@lru_cache(maxsize=_REMEMBERED)
def _word_worth(word: str) -> tuple[str, float]:
    """The bare form of a word and its worth before its frequency is taken off; none has 0.05."""
    bare = _NOT_BARE.sub("", word.lower())
    if not bare:
        return "", 0.05
    worth = 1.0
    for term in (
        -0.85 if bare in _STOPWORDS else 0.0,
        1.5 if _DIGIT.search(word) else 0.0,
        0.6 if "A" <= word[0] <= "Z" else 0.0,
        0.8 if _NAME_MARK.search(word) else 0.0,
        min(len(bare) / 8, 0.8),
    ):
        worth += term
    return bare, worth


#: Characters of texts whose words are indexed together.
_TOGETHER = 1 << 20


def rewrite_proses(texts: list[str], keep: float = 0.5) -> Iterator[str]:
    """The most telling share of each text's words, in their order. A word's worth is looked up once
    for all texts that are near each other."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _TOGETHER):
            size += len(texts[end])
            end += 1
        yield from _rewritten(texts[at:end], keep)
        at = end


def _rewritten(texts: list[str], keep: float) -> Iterator[str]:
    index: dict[str, int] = {}
    seen = index.setdefault
    words = [_WORD.findall(t) for t in texts]
    ids = [np.fromiter([seen(w, len(index)) for w in own], np.int64, len(own)) for own in words]
    bare_index: dict[str, int] = {"": 0}
    bare, worth = np.empty(len(index), np.int64), np.empty(len(index))
    for i, w in enumerate(index):
        b, worth[i] = _word_worth(w)
        bare[i] = bare_index.setdefault(b, len(bare_index))
    times = np.zeros(len(bare_index), np.int64)
    for text, own, i in zip(texts, words, ids, strict=True):
        if len(own) <= 3:
            yield text
            continue
        b = bare[i]
        np.add.at(times, b, 1)
        n = times[b]
        times[b] = 0
        n[b == 0] = 0
        score = worth[i] - 0.4 * (n / max(1, n.max()))
        kept = max(1, math.floor(len(own) * min(1.0, max(0.05, keep)) + 0.5))
        best = np.sort(np.argsort(-score, kind="stable")[:kept])
        yield " ".join([own[k] for k in best.tolist()])


def rewrite_prose(text: str, keep: float = 0.5) -> str:
    """The most telling share of the words, in their order."""
    return next(rewrite_proses([text], keep))


class Scorer(Protocol):
    """What the pruner by surprisal needs of a language model."""

    def encode(self, text: str) -> list[int]: ...

    def surprisal(self, ids: list[int]) -> list[float]:
        """``-log p`` of every token after those to its left; infinite for the first."""

    def decode(self, ids: list[int]) -> str: ...


def prune_by_surprisal(text: str, scorer: Scorer, keep: float = 0.5) -> str:
    """The least predictable share of a model's tokens, in their order."""
    ids = scorer.encode(text)
    if len(ids) <= 4:
        return text
    n = max(1, math.floor(len(ids) * min(1.0, max(0.05, keep)) + 0.5))
    best = np.sort(np.argsort(-np.asarray(scorer.surprisal(ids), np.float64), kind="stable")[:n])
    return re.sub(f"^{_S}+|{_S}+$", "", scorer.decode([ids[i] for i in best.tolist()]))


def prose_keep(level: str, keep: float | None) -> float:
    """The share of words that prose keeps, unless it is given."""
    return (0.3 if level == "aggressive" else 0.5) if keep is None else keep


def rewrite(text: str, kind: str, level: str = "safe", keep: float | None = None) -> str:
    if kind == "prose":
        return rewrite_prose(text, prose_keep(level, keep))
    return {"json": rewrite_json, "log": rewrite_log, "code": rewrite_code, "trace": rewrite_trace, "table": rewrite_table}[kind](text, level)
