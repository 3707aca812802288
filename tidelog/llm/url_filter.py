"""URL filter: rules first, then trust and distrust propagated over the host graph.

A page's links give edges between hosts (a relative link is an edge from the host to
itself), counted once for each link. Hosts of pages that rules allow are trusted
seeds, hosts of pages that rules block are distrusted seeds, each weighed by its
number of such pages. Trust is personalised PageRank from the trusted seeds along the
edges; distrust is the same from the blocked seeds against the edges, so that hosts
which link to bad ones share their score. A host whose distrust is over ``ratio``
times its trust is blocked; one without either is allowed.

Only DataFrame functions run here. Urls and links are taken apart once, and written.
Edges and pages are summed by host before they are joined; these sums are written
first, as Spark splits a join where one host has many rows if both sides come from
tables. A host's edges are dealt into parts for the rounds, of which every fourth ends
in a written table. Mass at hosts without edges is not dealt out again, which scales
all scores alike.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule,
takes no part in the graph and is allowed; a null html has no links; repeated pages
count each time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)(?:href|src)[ \t\r\n\f]*=[ \t\r\n\f]*["']?([^"' \t\r\n\f>]+)"""
#: A link that names no host: anything but a scheme of another kind or a place on the page.
RELATIVE = r"^(?![a-zA-Z][a-zA-Z0-9+.-]*:|#|//)"
LINK_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # with its leading slash

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
DAMPING, ROUNDS, RATIO = 0.85, 12, 1.0
#: Steps of one host that are brought together.
STEPS_OF_PART = 1 << 14


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict. The longest rule wins, host and path
    together; of equally long ones the first given."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", F.regexp_extract(url, PATH, 1))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return out.withColumn("rule", name).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n of the links in ``html`` of pages with a ``host``."""
    link = (
        pages.where("host <> '' and html is not null")
        .select("host", F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), 1)).alias("link"))
    )
    named = lower_ascii(F.regexp_extract("link", LINK_HOST, 1))
    target = F.when(named != "", named).when(F.col("link").rlike(RELATIVE), F.col("host"))
    return (
        link.select(F.col("host").alias("src"), target.alias("dst"))
        .where("dst is not null")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, ws: Workspace, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``edges(src, dst, n)`` and ``seeds(host, allowed, blocked)`` to (host, trust, distrust).
    A host's steps are dealt into ``parts`` of ``STEPS_OF_PART`` or so, and its score is sent to
    each of them; a step tells how many parts its target has, so that costs no join."""
    edges = ws.save(edges, "edges")
    ends = edges.select(F.col("src").alias("host"), F.col("n").alias("out_n"), F.lit(None).cast("long").alias("in_n")).unionByName(
        edges.select(F.col("dst").alias("host"), F.lit(None).cast("long").alias("out_n"), F.col("n").alias("in_n"))
    )
    parts = lambda c: F.greatest(F.ceil(F.count(c) / F.lit(STEPS_OF_PART)), F.lit(1)).cast("int")
    hosts = ws.save(
        ends.groupBy("host").agg(F.sum("out_n").alias("out_n"), F.sum("in_n").alias("in_n"), parts("out_n").alias("out_parts"), parts("in_n").alias("in_parts")), "hosts"
    )
    of = lambda end: hosts.select(*[F.col(c).alias(f"{end}_{c}" if c != "host" else end) for c in hosts.columns])
    known = edges.join(of("src"), "src").join(of("dst"), "dst")
    steps = lambda kind, end, other, side: known.select(
        F.lit(kind).alias("kind"), F.col(end).alias("host"), F.pmod(F.xxhash64(other), F.col(f"{end}_{side}_parts")).cast("int").alias("part"),
        F.col(other).alias("to"), F.col(f"{other}_{side}_parts").alias("to_parts"), (F.col("n") / F.col(f"{end}_{side}_n")).alias("share"),
    )
    steps = ws.save(steps("trust", "src", "dst", "out").unionByName(steps("distrust", "dst", "src", "in")), "steps")
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()  # one row
    begun = seeds.join(hosts, "host", "left")
    start = lambda kind, c, n, side: begun.where(F.col(c) > 0).select(
        F.lit(kind).alias("kind"), "host", (F.col(c) / F.lit(float(n or 1))).alias("seed"), F.coalesce(f"{side}_parts", F.lit(1)).alias("parts")
    )
    start = ws.save(start("trust", "allowed", total.a, "out").unionByName(start("distrust", "blocked", total.b, "in")), "seeds")
    score = start.withColumnRenamed("seed", "score")
    for k in range(rounds):
        dealt = score.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = steps.join(dealt, ["kind", "host", "part"]).select(
            "kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"), F.col("to_parts").alias("parts")
        )
        given = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"), "parts")
        score = sent.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.max("parts").alias("parts"))
        if k % 4 == 3 or k == rounds - 1:
            score = ws.save(score, f"score-{k}")
            ws.drop(f"score-{k - 4}")
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return ws.save(score.groupBy("host").agg(part("trust"), part("distrust")), "scores")


def judge(pages: DataFrame, ws: Workspace, rules: tuple[Rule, ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    own = pages.select(F.col("page_id").cast("long"), "url", "html")
    named = ws.save(with_rule(own.drop("html"), rules).drop("url"), "named")
    count = lambda v: F.count(F.when(F.col("rule_verdict") == v, 1))
    seeds = ws.save(named.where("rule is not null").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")), "counts")
    scores = propagate(host_edges(own.withColumn("host", host_of(F.col("url")))), seeds, ws)
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return named.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "trust", "distrust"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Workspace(spark, "url-filter")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = [
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN "
        for r in sorted(RULES, key=lambda r: -len(r.name))
    ]
    rules = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda of: "CASE " + " ".join(f"{f}'{of(r)}'" for f, r in zip(fits, rules, strict=True)) + " END"
    quoted = lambda p: p.replace("'", "''")
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    # RE2 has no look-ahead: the relative links are those that none of the other patterns takes.
    out = f"""
WITH u AS (
  SELECT page_id, html, {lower(f"regexp_extract(coalesce(url, ''), '{HOST}', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path
  FROM pages
), p AS MATERIALIZED (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS rule_verdict FROM u),
l AS (SELECT host, unnest(regexp_extract_all(html, '{quoted(LINK)}', 1)) AS link FROM p WHERE host <> '' AND html IS NOT NULL),
t AS (
  SELECT host AS src, CASE WHEN {lower(f"regexp_extract(link, '{LINK_HOST}', 1)")} <> '' THEN {lower(f"regexp_extract(link, '{LINK_HOST}', 1)")}
         WHEN NOT regexp_matches(link, '^([a-zA-Z][a-zA-Z0-9+.-]*:|#|//)') THEN host END AS dst
  FROM l
),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY ALL),
s AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst AS target, n / sum(n) OVER (PARTITION BY src) AS share FROM e
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e
),
c AS (SELECT host, count(*) FILTER (rule_verdict = 'allow') AS a, count(*) FILTER (rule_verdict = 'block') AS b FROM p WHERE rule IS NOT NULL GROUP BY host),
r0 AS MATERIALIZED (
  SELECT 'trust' AS kind, host, a / (SELECT sum(a) FROM c) AS score FROM c WHERE a > 0
  UNION ALL SELECT 'distrust', host, b / (SELECT sum(b) FROM c) FROM c WHERE b > 0
)"""
    for k in range(1, ROUNDS + 1):
        out += f""",
r{k} AS MATERIALIZED (
  SELECT kind, host, sum(score) AS score FROM (
    SELECT s.kind, s.target AS host, {DAMPING} * s.share * r.score AS score FROM s JOIN r{k - 1} r ON s.kind = r.kind AND s.host = r.host
    UNION ALL SELECT kind, host, (1 - {DAMPING}) * score FROM r0) GROUP BY ALL
)"""
    return out + f""",
h AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.rule_verdict, CASE WHEN coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN h ON p.host = h.host
"""


SQL = _sql()
