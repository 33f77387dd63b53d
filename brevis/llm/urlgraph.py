"""URL filters with link-graph propagation, in DataFrame functions only.

Each url is judged by the longest allow or block rule that fits it. Urls without a rule take the
verdict of their host: trust starts at hosts in proportion to their allowed pages and follows
links (personalised PageRank); distrust starts at hosts in proportion to their blocked pages and
follows links backwards, to the hosts that link there. A host whose distrust exceeds
``threshold`` times its trust is blocked. Hosts that neither reaches are allowed.

Ranks are whole numbers (``UNIT`` to a page) rounded down at every step, so sums do not depend on
the order of rows. Steps end when no rank changes any more, or after ``STEPS``: what is farther from
all seeds than so many links has no rank, and a host passes on shares of one unit at least, so one
of 850 million links or more to a page of trust passes nothing on. Links are counted per pair of hosts
before they are joined; a host with very many links is split by adaptive execution where ranks are too
many to broadcast.

Defined results: a url that is null or without ``://`` has an empty host and path and is allowed;
null pages have no links; repeated rows count each; an empty table gives no rows. Of rules of equal
length the later one in the list is taken, and a host of equal trust and distrust is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.session import drop_staged, staged

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UNIT = 1_000_000_000
DAMPING = 0.85
STEPS = 30
THRESHOLD = 1.0
#: Rank tables of at most so many hosts are broadcast (about 100 bytes each).
BROADCAST_HOSTS = 100_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def ruled(host: str, path: str, rules=RULES) -> tuple[Column, Column]:  # noqa: ANN001
    """The longest fitting rule (or null) and its verdict (or null)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, counted."""
    host, _ = parse("url")
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_ranks(judged: DataFrame, links: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` of every host that a seed or a link names.

    Both flows share one edge table: distrust runs along the reversed edges. Every step is one
    join and one pre-aggregated sum.
    """
    seeds = judged.filter(F.col("host") != "").groupBy("host").agg(
        (F.count(F.when(F.col("verdict") == "allow", 1)) * UNIT).alias("t"), (F.count(F.when(F.col("verdict") == "block", 1)) * UNIT).alias("d"))
    seeds = staged(seeds.select(F.explode(F.array(F.struct(F.lit("t").alias("flow"), "host", F.col("t").alias("seed")), F.struct(F.lit("d").alias("flow"), "host", F.col("d").alias("seed")))).alias("x")).select("x.*").filter("seed > 0"), "url-seeds")
    both = links.select(F.explode(F.array(F.struct(F.lit("t").alias("flow"), F.col("src").alias("host"), F.col("dst").alias("to"), "n"), F.struct(F.lit("d").alias("flow"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))).alias("x")).select("x.*")
    degree = both.groupBy("flow", "host").agg(F.sum("n").alias("all"))
    edges = staged(both.join(degree, ["flow", "host"]).select("flow", "host", "to", (F.col("n") / F.col("all")).alias("share")), "url-edges")
    ranks = seeds.select("flow", "host", F.col("seed").alias("rank"))
    small = edges.select("flow", "host").union(edges.select("flow", "to")).union(seeds.select("flow", "host")).distinct().count() <= BROADCAST_HOSTS
    print_of = lambda r: r.agg(F.count("*"), F.sum(F.xxhash64("flow", "host", "rank").cast("decimal(38,0)"))).first()
    seen = None
    for step in range(steps):
        given = F.broadcast(ranks) if small else ranks
        moved = edges.join(given, ["flow", "host"]).select("flow", F.col("to").alias("host"), F.floor(F.col("rank") * F.col("share") * damping).alias("rank"))
        kept = seeds.select("flow", "host", F.floor(F.col("seed") * (1 - damping)).alias("rank"))
        new = staged(moved.union(kept).groupBy("flow", "host").agg(F.sum("rank").alias("rank")), f"url-ranks{step}")
        drop_staged(ranks)
        ranks, before, seen = new, seen, print_of(new)
        if seen == before:
            break
    one = lambda flow: F.coalesce(F.sum(F.when(F.col("flow") == flow, F.col("rank"))), F.lit(0))
    return ranks.groupBy("host").agg(one("t").alias("trust"), one("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:  # noqa: ANN001
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    host, path = parse("url")
    name, verdict = ruled("host", "path", rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": name, "verdict": verdict})
    judged = staged(judged, "url-pages")
    ranks = staged(host_ranks(judged, host_links(pages)), "url-hosts")
    if ranks.count() <= BROADCAST_HOSTS:
        ranks = F.broadcast(ranks)
    out = judged.join(ranks, "host", "left")
    blocked = F.coalesce(F.col("distrust") > F.col("trust") * threshold, F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )


def sql(rules=RULES, steps: int = STEPS) -> str:  # noqa: ANN001
    """The same rows in DuckDB's SQL."""
    longest = sorted(reversed(rules), key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in longest]
    name = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in zip(fits, longest, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, longest, strict=True))
    link = LINK.replace("'", "''")
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    rank = "SELECT flow, host, CAST(seed AS BIGINT) AS rank FROM seeds"
    parts = [f"r0 AS MATERIALIZED ({rank})"]
    for k in range(steps):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT flow, host, CAST(sum(rank) AS BIGINT) AS rank FROM ("
            f"SELECT e.flow, e.dest AS host, CAST(floor(r.rank * e.share * {DAMPING}) AS BIGINT) AS rank FROM edges e JOIN r{k} r ON e.flow = r.flow AND e.host = r.host "
            f"UNION ALL SELECT flow, host, CAST(floor(seed * (1 - CAST({DAMPING} AS DOUBLE))) AS BIGINT) FROM seeds) GROUP BY flow, host)"
        )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} END AS ruled FROM p),
l AS (SELECT host AS src, {lower.format("dst")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM p)),
c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND src <> dst GROUP BY src, dst),
b AS (SELECT 't' AS flow, src AS host, dst AS dest, n FROM c UNION ALL SELECT 'd', dst, src, n FROM c),
edges AS MATERIALIZED (SELECT flow, host, dest, n / sum(n) OVER (PARTITION BY flow, host) AS share FROM b),
s AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') * {UNIT} AS t, count(*) FILTER (WHERE ruled = 'block') * {UNIT} AS d FROM j WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT 't' AS flow, host, t AS seed FROM s WHERE t > 0 UNION ALL SELECT 'd', host, d FROM s WHERE d > 0),
{", ".join(parts)},
h AS (SELECT host, CAST(coalesce(sum(rank) FILTER (WHERE flow = 't'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(rank) FILTER (WHERE flow = 'd'), 0) AS BIGINT) AS distrust FROM r{steps} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust * CAST({THRESHOLD} AS DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM j LEFT JOIN h ON j.host = h.host"""
