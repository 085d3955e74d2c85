"""URL filter: rules, and link-graph propagation for what no rule decides.

A rule blocks or allows a host with its subdomains below a path; the longest fitting rule wins. For the
other pages, trust flows along the edges between hosts from pages that rules allow (personalised
PageRank), and distrust flows against them from pages that rules block. Edges are links from a page's
host to another host, and the ties between a host and the domain it belongs to, both ways. Beside each
flow runs the same flow from all pages; their ratio is the share of a host's standing that comes from
allowed or blocked pages, whatever the size of the graph. A host is blocked if its share of distrust
reaches the threshold and its share of trust does not exceed it.

Scores are integers (``UNIT`` per page, divisions round down), so results do not depend on the order of
sums. Edges are distinct host pairs. A host with very many edges is split into pieces of ``PIECE``
edges, and its score goes to each piece; sums are combined before the shuffle. Each round is stored.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed;
a null html has no links; repeated rows count as pages of their own; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import ascii_lower, store, table
from outage_spark.operators.spread import lookup_join

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UNIT = 1_000_000
FOLLOWED = 85  # percent of a score that is passed on
ROUNDS = 10
THRESHOLD = 0.5
PIECE = 100_000
LINK = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_and_path(url: str) -> tuple[Column, Column]:
    body = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(body, "://")
    rest = F.when(at > 0, F.substring(body, at + 3, F.length(body))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _domains(host: str, least: int) -> Column:
    """The host and the domains it belongs to, down to ``least`` labels."""
    labels = F.split(host, r"\.")
    last = F.size(labels) - least
    return F.when(
        (F.col(host) != "") & (last >= 0),
        F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")),
    ).otherwise(F.array().cast("array<string>"))


def _rule_table(spark, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row per rule host, with its rules from the longest on."""
    each = [
        F.struct(
            F.lit(rule.split("/", 1)[0].lower()).alias("domain"),
            F.struct(
                F.lit(-len(rule)).alias("order"), F.lit(rule).alias("rule"), F.lit("/" + rule.split("/", 1)[1]).alias("path"),
                F.lit(verdict).alias("verdict"),
            ).alias("r"),
        )
        for rule, verdict in rules
    ]
    rows = spark.range(1).select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return rows.groupBy("domain").agg(F.collect_set("r").alias("rules"))


def apply_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` (with ``host``, ``path``) and the struct ``fit`` (rule, verdict) of the longest fitting rule, or null."""
    hosts = pages.select("host").distinct()
    pairs = hosts.select("host", F.explode(_domains("host", 1)).alias("domain"))
    by_host = lookup_join(pairs, _rule_table(pages.sparkSession, rules), ["domain"], "inner")
    by_host = by_host.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("rules"))).alias("rules"))
    rows = lookup_join(pages, by_host, ["host"], "left")
    fit = F.get(F.filter("rules", lambda r: F.col("path").startswith(r.path)), F.lit(0))
    return rows.withColumn("fit", fit).drop("rules")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct ``src, dst``: links between hosts, and ties between hosts and their domains."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).withColumn("dst", ascii_lower("dst")).distinct()
    nodes = links.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(pages.select("host")).distinct()
    chain = nodes.select(_domains("host", 2).alias("d")).select(
        F.explode(F.filter(F.arrays_zip(F.col("d").alias("a"), F.slice("d", F.lit(2), F.size("d") + 1).alias("b")), lambda t: t.b.isNotNull())).alias("t")
    )
    ties = chain.select(F.explode(F.array(F.struct(F.col("t.a").alias("src"), F.col("t.b").alias("dst")), F.struct(F.col("t.b").alias("src"), F.col("t.a").alias("dst")))).alias("e"))
    edges = links.unionByName(ties.select("e.*")).where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return edges.distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, piece: int = PIECE) -> DataFrame:
    """``host, trust, trust_all, distrust, distrust_all`` from ``seeds`` (host, n_all, n_allow, n_block)."""
    both = store(
        edges.select(F.lit(0).alias("way"), F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(
            edges.select(F.lit(1).alias("way"), F.col("dst").alias("node"), F.col("src").alias("to"))
        )
    )
    degrees = both.groupBy("way", "node").agg(F.count(F.lit(1)).alias("degree"))
    nodes = seeds.select("host").unionByName(both.select(F.col("node").alias("host"))).distinct()
    counts = nodes.join(seeds, "host", "left").na.fill(0, ["n_all", "n_allow", "n_block"])
    ways = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.col(c).alias("own")) for w, c in ((0, "n_allow"), (1, "n_block"))]))
    base = counts.select(F.col("host").alias("node"), "n_all", ways.alias("w")).select("node", "n_all", "w.*")
    base = base.join(degrees, ["way", "node"], "left").select(
        "way", "node", "degree",
        (F.col("own") * UNIT).cast("bigint").alias("seed"), (F.col("n_all") * UNIT).cast("bigint").alias("seed_all"),
    )
    base = store(base)
    pieces = F.greatest(F.ceil(F.col("degree") / piece), F.lit(1)).cast("int")
    outgoing = store(
        both.join(degrees, ["way", "node"]).select("way", "node", "to", "degree", F.pmod(F.xxhash64("to"), pieces).cast("int").alias("piece"))
    )
    now = base.select("way", "node", "degree", F.col("seed").alias("score"), F.col("seed_all").alias("score_all"))
    for _ in range(rounds):
        sent = now.where(F.col("degree").isNotNull()).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("degree")
        flow = outgoing.join(sent, ["way", "node", "piece"])
        came = flow.groupBy("way", F.col("to").alias("node")).agg(
            F.sum(F.expr("score div degree")).alias("came"), F.sum(F.expr("score_all div degree")).alias("came_all")
        )

        def part(own: str, came: str) -> Column:
            return F.expr(f"({own} * {100 - FOLLOWED}) div 100 + (coalesce({came}, 0) * {FOLLOWED}) div 100")

        now = store(
            base.join(came, ["way", "node"], "left").select(
                "way", "node", "degree", part("seed", "came").alias("score"), part("seed_all", "came_all").alias("score_all")
            )
        )

    def of(way: int, column: str) -> Column:
        return F.max(F.when(F.col("way") == way, F.col(column)))

    return now.groupBy(F.col("node").alias("host")).agg(
        of(0, "score").alias("trust"), of(0, "score_all").alias("trust_all"),
        of(1, "score").alias("distrust"), of(1, "score_all").alias("distrust_all"),
    )


def judge_hosts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, trust_share, distrust_share, host_verdict``."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    rows = scores.select("host", share("trust", "trust_all").alias("trust_share"), share("distrust", "distrust_all").alias("distrust_share"))
    bad = (F.col("distrust_share") >= threshold) & (F.col("distrust_share") >= F.col("trust_share"))
    return rows.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge_pages(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust_share, distrust_share`` for every page."""
    host, path = host_and_path(url)
    rows = pages.select(page_id, host.alias("host"), path.alias("path"), html)
    judged = apply_rules(rows.select(page_id, "host", "path"), rules)
    decided = F.col("fit.verdict")
    seeds = judged.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(decided == "allow", 1)).alias("n_allow"), F.count(F.when(decided == "block", 1)).alias("n_block")
    )
    hosts = judge_hosts(propagate(host_edges(rows, html), seeds))
    out = lookup_join(judged, hosts, ["host"], "left")
    verdict = F.coalesce(decided, F.col("host_verdict"), F.lit("allow"))
    return out.select(page_id, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "trust_share", "distrust_share")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def _op1_sql() -> str:
    rules = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)
    rounds = "r0 AS (SELECT way, node, degree, seed AS score, seed_all AS score_all FROM base)"
    for i in range(1, ROUNDS + 1):
        rounds += f""",
c{i} AS (SELECT e.way, e.dst AS node, sum(score // degree)::BIGINT AS came, sum(score_all // degree)::BIGINT AS came_all
       FROM both_ways e JOIN r{i - 1} r ON e.way = r.way AND e.node = r.node GROUP BY 1, 2),
r{i} AS (SELECT b.way, b.node, degree, (seed * {100 - FOLLOWED}) // 100 + (coalesce(came, 0) * {FOLLOWED}) // 100 AS score,
       (seed_all * {100 - FOLLOWED}) // 100 + (coalesce(came_all, 0) * {FOLLOWED}) // 100 AS score_all
       FROM base b LEFT JOIN c{i} c ON b.way = c.way AND b.node = c.node)"""
    link = LINK.replace("'", "''").replace('\\"', '"')
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH raw AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {upper}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
rules(rule, domain, prefix, verdict) AS (VALUES {rules}),
judged AS (
  SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN rules
    ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule) = 1),
seeds AS (
  SELECT host, count(*) AS n_all, count(*) FILTER (verdict = 'allow') AS n_allow, count(*) FILTER (verdict = 'block') AS n_block
  FROM judged WHERE host <> '' GROUP BY host),
links AS (
  SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {upper}) AS dst FROM p),
hosts AS (SELECT host FROM p UNION SELECT src FROM links UNION SELECT dst FROM links),
labels AS (SELECT string_split(host, '.') AS l FROM hosts WHERE host <> ''),
ties AS (
  SELECT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels)),
edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links UNION ALL SELECT a, b FROM ties UNION ALL SELECT b, a FROM ties)
  WHERE src <> '' AND dst <> '' AND src <> dst),
both_ways AS (SELECT 0 AS way, src AS node, dst FROM edges UNION ALL SELECT 1, dst, src FROM edges),
degrees AS (SELECT way, node, count(*) AS degree FROM both_ways GROUP BY 1, 2),
nodes AS (SELECT host FROM seeds UNION SELECT node FROM both_ways),
base AS (
  SELECT w.way, host AS node, degree, (CASE w.way WHEN 0 THEN coalesce(n_allow, 0) ELSE coalesce(n_block, 0) END * {UNIT})::BIGINT AS seed,
         (coalesce(n_all, 0) * {UNIT})::BIGINT AS seed_all
  FROM nodes LEFT JOIN seeds USING (host) CROSS JOIN (VALUES (0), (1)) AS w(way) LEFT JOIN degrees d ON d.way = w.way AND d.node = host),
{rounds},
scores AS (
  SELECT node AS host, max(score) FILTER (way = 0) AS trust, max(score_all) FILTER (way = 0) AS trust_all,
         max(score) FILTER (way = 1) AS distrust, max(score_all) FILTER (way = 1) AS distrust_all
  FROM r{ROUNDS} GROUP BY node),
shares AS (
  SELECT host, CASE WHEN trust_all > 0 THEN trust / trust_all ELSE 0.0 END AS trust_share,
         CASE WHEN distrust_all > 0 THEN distrust / distrust_all ELSE 0.0 END AS distrust_share FROM scores)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN distrust_share >= {THRESHOLD} AND distrust_share >= trust_share THEN 'block' ELSE 'allow' END) AS verdict,
       trust_share, distrust_share
FROM judged LEFT JOIN shares USING (host)
"""


OP1_SQL = _op1_sql()
