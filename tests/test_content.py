import pytest
from samples import JSON, LOG, SAMPLES, STACK, TESTS

from brevis.functions import line_rules
from brevis.functions import rewriting as R
from brevis.functions.text import SPACE
from brevis.operators import content


@pytest.mark.parametrize("level", ["safe", "aggressive"])
def test_samples(spark, level):
    df = spark.createDataFrame([(k, s[1], s[4]) for k, s in SAMPLES.items()], "name string, text string, markers array<string>")
    found = content.signal_recall(content.compress_content(df, level=level), "compressed", "markers")
    for r in found.collect():
        kind, text, safe, aggressive, _ = SAMPLES[r["name"]]
        assert r["type"] == kind, r["name"]
        assert r["compressed"] == (safe if level == "safe" else aggressive), r["name"]
        assert r["original_tokens"] == -(-len(text) // 4) and r["compressed_tokens"] == -(-len(r["compressed"]) // 4)
        assert r["n_surviving"] == r["n_markers"]


def test_detection_cases(spark):
    cases = {
        "": "prose", '{"a":1}\n{"b":2}': "prose", '{"a":NaN}': "prose", '{"a":1}': "json", "a,b\nc,d\ne,f": "table",
        LOG + "\n" + "\n".join(STACK.split("\n")[1:3]): "trace", " [1, 2] ": "json", "[1] x]": "prose",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: r["type"] for r in df.select("text", content.detect_type("text").alias("type")).collect()}
    assert got == cases


def test_null_text_counts_as_empty(spark):
    row = content.compress_content(spark.createDataFrame([(None,)], "text string")).first()
    assert (row["type"], row["compressed"], row["original_tokens"]) == ("prose", "", 0)


def test_log_rules():
    assert R.rewrite_log("errors\nwarnings\njob_failed", "aggressive") == "(3 routine log lines omitted)"
    assert R.rewrite_log("an error", "aggressive") == "an error"
    assert R.rewrite_log("a 1\n\na 2\nb (11ms)\nb (12ms)") == "2× a #\nb (11ms)\nb (12ms)"


def test_json_rules():
    assert R.rewrite_json("[1,2,3]") == "[1,2,3]"
    assert R.rewrite_json('[1,2,{"error":1},{"error":2}]') == '[1,2,{"error":1},{"error":2},"…(0 more similar items)"]'
    assert R.rewrite_json("not json") == "not json"
    assert '"…(6× {id,state})"]' in R.rewrite_json(JSON, "aggressive")
    assert R.rewrite_json('{"b":1.0,"2":1e21,"1":1e-7,"b":0.5}') == '{"1":1e-7,"2":1e+21,"b":0.5}'
    assert R.rewrite_json('"' + "x" * 201 + '"') == '"' + "x" * 200 + '…(201 chars)"'


def test_trace_rules():
    assert R.rewrite_trace(TESTS).startswith("(4 passing tests)\nFAIL")
    assert R.rewrite_trace("✓ a\nhello\n✓ b\nFAIL c") == "hello\n(2 passing tests)\nFAIL c"
    assert R.rewrite_trace("x\n  at a (node_modules/b:1:1)") == "x\n    … 1 library frame …"


def test_table_and_code_rules():
    assert R.pick_delimiter(["a,b", "c,d", "e,f,g", "h,i,j"]) is None
    assert R.rewrite_table("a|b\n-|-\nc|d") == "a|b\n-|-\nc|d"
    assert R.rewrite_code("x = 1; // note\nu = 'http://a'") == "x = 1;\nu = 'http://a'"
    assert R.rewrite_code("if x:\n    y\n\n\tz", "aggressive") == "if x:\n  y\n z"


def test_prose_rules():
    assert R.rewrite_prose("one two three") == "one two three"
    assert len(R.rewrite_prose("w " * 40, 0).split()) == 2
    assert len(R.rewrite_prose("w " * 40, 2).split()) == 40
    assert R.rewrite_prose("same same same same", 0.5) == "same same"


def plain_prose(text, keep):
    """The prose rules word by word."""
    import collections
    import math
    import re

    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    if len(words) <= 3:
        return text
    bare = [re.sub("[^a-z0-9]", "", w.lower()) for w in words]
    times = collections.Counter(b for b in bare if b)
    score = []
    for w, b in zip(words, bare, strict=True):
        s = 1.0
        for term in (-0.85 if b in R.STOPWORDS.split() else 0, 1.5 if re.search("[0-9]", w) else 0, 0.6 if re.match("[A-Z]", w) else 0, 0.8 if set(w) & set("_/.\\{}()=<>:#@[]") else 0, min(len(b) / 8, 0.8)):
            s += term
        score.append(s - 0.4 * (times[b] / max(times.values())) if b else 0.05)
    n = max(1, math.floor(len(words) * min(1.0, max(0.05, keep)) + 0.5))
    best = sorted(range(len(words)), key=lambda i: (-score[i], i))[:n]
    return " ".join(words[i] for i in sorted(best))


@pytest.mark.parametrize("keep", [0.0, 0.3, 0.5, 1.0])
def test_prose_of_many_texts(keep):
    import random

    r = random.Random(5)
    words = ["the", "The", "of", "a.b", "x_1", "2024", "Ünder", "für", "漢字", "!!", "…", "Word", "word", "word,", "LONGERWORDS", "it's", "42%", "/path", "\u00a0", "zz"]
    texts = ["", "one", "!! ?? !! ??", *(r.choice([" ", "\n", "  "]).join(r.choices(words, k=r.randint(0, 60))) for _ in range(300)), " ".join(words) * 20]
    assert list(R.rewrite_proses(texts, keep)) == [plain_prose(t, keep) for t in texts]


def test_store_round_trip(spark):
    texts = spark.createDataFrame([(0, "a"), (35, "b" * 50), (36, None)], "k bigint, text string")
    store = content.store(texts, "k")
    assert {r["handle"] for r in store.collect()} == {"ccr_0", "ccr_z", "ccr_10"}
    asked = spark.createDataFrame([("ccr_z",), ("ccr_q",)], "handle string")
    got = {r["handle"]: r for r in content.retrieve(asked, store, limit=20).collect()}
    assert got["ccr_z"]["truncated"] and got["ccr_z"]["length"] == 50 and got["ccr_z"]["original"].startswith("b" * 20 + "\n")
    assert got["ccr_q"]["original"] is None and not got["ccr_q"]["truncated"]
    named = spark.createDataFrame([(1, "«brevis:retrieve ccr_0» «brevis:retrieve ccr_0» «brevis:retrieve ccr_nope»")], "id int, c string")
    assert [r["original"] for r in content.retrieve_all(named, "c", store, "id").collect()] == ["a"]


def test_marker_can_cost_more_than_it_saves(spark):
    row = content.compress_content(spark.createDataFrame([(5, "tiny")], "k bigint, text string"), key="k").first()
    assert row["compressed"] == "tiny\n«brevis:retrieve ccr_5»" and row["saved"] < 0


def test_delimiters(spark):
    cases = {"a,b\nc,d\ne,f": (",", 2), "a\tb\tc\nd\te\tf": ("\t", 3), "a|b\n-|-\nc|d": ("|", 2), "a,b\nc,d\ne,f,g\nh,i,j": None, "a b": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "text string").select("text", line_rules.pick_delimiter("text").alias("d"))
    assert {r["text"]: r["d"] and tuple(r["d"]) for r in df.collect()} == cases
    assert {k: R.pick_delimiter([x for x in k.split("\n") if x.strip()]) for k in cases} == cases


def test_tools(spark):
    calls = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None)], "id bigint, content string")
    made = {r["id"]: r for r in content.compress_tool(calls, "id").collect()}
    assert made[1]["handle"] == "ccr_1" and made[1]["error"] is None and made[1]["compressed"].startswith("one two three\n")
    assert all(made[i]["error"] and made[i]["handle"] is None and made[i]["compressed"] is None for i in (2, 3))
    for bad in ({"keep": 0.01}, {"keep": 2}, {"kind": "poem"}, {"level": "rough"}):
        with pytest.raises(ValueError):
            content.compress_tool(calls, "id", **bad)
    originals = content.store(calls, "id", "content")
    asked = spark.createDataFrame([("ccr_1",), ("ccr_9",), ("CCR-1",), (None,)], "handle string")
    found = {r["handle"]: r for r in content.retrieve_tool(asked, originals, limit=5).collect()}
    assert found["ccr_1"]["original"].startswith("one t\n") and found["ccr_1"]["truncated"] and found["ccr_1"]["error"] is None
    assert found["ccr_9"]["error"] == "unknown handle" and "letters" in found["CCR-1"]["error"] and "letters" in found[None]["error"]


def test_another_token_counter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b c d e f",)], "text string")
    row = content.compress_content(df, count=lambda c: F.size(F.split(c, " ")).cast("bigint")).first()
    assert (row["original_tokens"], row["compressed_tokens"], row["ratio"]) == (6, 3, 2.0)


def test_pruning_by_surprisal(spark):
    class Rare:
        """A word costs more the rarer its first letter is held to be."""

        def encode(self, text):
            return [ord(w[0]) for w in text.split()]

        def surprisal(self, ids):
            return [float("inf"), *(float(i) for i in ids[1:])]

        def decode(self, ids):
            return " ".join(map(chr, ids))

    df = spark.createDataFrame([("a b z c y d",), ("a b c d",), (None,)], "text string")
    assert [r["pruned"] for r in content.prune_with_model(df, Rare, 0.5).collect()] == ["a z y", "a b c d", ""]
    assert R.prune_by_surprisal("a b c d e", Rare(), 0) == "a"


def test_detection_from_another_folder(tmp_path):
    """Workers find the package where the driver does not run in its folder."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys; sys.path.insert(0, sys.argv[1])
from brevis.operators import content
from brevis.session import build_session
spark = build_session("other", cpus=1, **{"spark.driver.memory": "1g"})
print("types", [r[0] for r in spark.createDataFrame([("{}",), ("x",)], "text string").select(content.detect_type("text")).collect()])
"""
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[1])], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "types ['json', 'prose']" in out.stdout, out.stderr[-2000:]


LINES = [
    "", "  ", "\t", "plain line 12", "plain line 13", "plain line 13.5 of 0xAF", "2031-02-03 04:05:06 INFO job 7", "  2031-02-03T04:05:06.5Z INFO job 8", "an ERROR here", "errors only", "job_failed 3", "über b fail 3",
    "    at x (node_modules/y.js:1:2)", "  at z (src/z.js:1:2)", '  File "/usr/lib/x.py", line 3', '  File "own.py", line 3', "✓ passed", "PASS one", "  ok 12 fine", "FAIL two", "not ok 3", "2 passing", "Tests: 5 failed", "expected 3",
    "- minus", "SomeError: x", "a,b,c", "a,,c", ",x", "1|2|3", "-|-|-", "| null | 3 |", "deadbeef01 x", "DEADBEEF0 y", "x // note", "/* a", "b */ c", "# hash", "    indented { }", "\t\tdeep(); ", "url http://x/y", "\u00a0nbsp\u2003", "12ms 12 ms", "end\r",
]


@pytest.mark.parametrize("level", ["safe", "aggressive"])
def test_line_rules_in_the_jvm_and_line_by_line(spark, level):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    texts = ["", "\n", "one", *("\n".join(r.choice(LINES) for _ in range(r.randint(1, 14))) for _ in range(600)), *("\n".join(r.choice(LINES[12:26]) for _ in range(r.randint(3, 14))) for _ in range(300))]
    texts += ["\n".join(f"{k},{r.choice(['x', 'null', '', 'y'])},{k % 3}" for k in range(r.randint(2, 12))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = df.select("text", *(rule(F.col("text"), level).alias(k) for k, rule in line_rules.RULES.items())).collect()
    assert len(got) == len(texts)
    for row in got:
        for kind in line_rules.RULES:
            assert row[kind] == R.rewrite(row["text"], kind, level), (kind, row["text"])


def test_line_rules_need_no_python(spark):
    df = spark.createDataFrame([("a",)], "text string")
    for kind in ("log", "trace", "table", "code"):
        plan = content.compress_content(df, kind=kind)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
