"""URL filters: explicit rules first, then trust and distrust over the graph of hosts.

Hosts of pages that rules allow seed trust, hosts of pages that rules block seed distrust.
Trust runs along links as a personalised PageRank; distrust runs against them, to hosts that
link to distrusted ones. A host that has more distrust than trust is blocked. All of it is
DataFrame work; only (host, host) edges and one row per host take part in the rounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_on_hot_key


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
#: Rounds of propagation in the SQL, the share of a score that moves on, and the margin of distrust over trust, as a share of trust, that blocks.
ROUNDS = 8
DAMPING = 0.85
MARGIN = 1e-9
#: Propagation ends when no score changes by more than this share of it; what is still to come is then within the margin.
TOLERANCE = MARGIN * (1 - DAMPING) / DAMPING
#: Rounds between two checkpoints.
_CUT_EVERY = 4
#: Absolute links of a page's html; group 1 is the host.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``, both empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def rule_of(rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, as struct ``(name, verdict)``, else null."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html_col: str = "html", parents: bool = False) -> DataFrame:
    """Edges ``(src, dst)`` between hosts of ``pages(host, html)``, each once.

    A link in a page's html leads to its host; links within a host are none. With ``parents``, a
    host and the nearest host above it that the table has (``blog.a.net`` and ``a.net``) lead to
    each other as well.
    """
    linked = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    links = linked.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> src").distinct()
    if not parents:
        return links
    hosts = pages.select("host").where("host <> ''").distinct()
    labels = F.size(F.split("host", r"\."))
    above = hosts.where(labels > 1).select("host", F.explode(F.sequence(F.lit(1), labels - 1)).alias("k"))
    above = above.withColumn("up", F.array_join(F.slice(F.split("host", r"\."), F.col("k") + 1, F.lit(1 << 30)), "."))
    nearest = above.join(hosts.withColumnRenamed("host", "up"), "up").groupBy("host").agg(F.min_by("up", "k").alias("up"))
    both = nearest.select(F.col("host").alias("src"), F.col("up").alias("dst")).union(nearest.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    return links.union(both).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Scores ``(kind, node, score)`` from ``edges(kind, src, dst)`` and ``seeds(kind, node, mass)``.

    A node hands its score in equal parts to the nodes it leads to and starts from its seed's
    share in each round. ``kind`` keeps several graphs apart in one set of joins. Scores grow
    from round to round; the rounds end when none grew by more than ``tolerance`` of itself, so
    not before every node that a seed reaches, however far, has a score.
    """
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    start = cut(seeds.join(F.broadcast(total), "kind").select("kind", "node", (F.lit(1 - damping) * F.col("mass") / F.col("total")).alias("seed")))
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("out"))
    key, same = F.xxhash64("kind", "src"), (F.col("kind") == F.col("__kind")) & (F.col("src") == F.col("__node"))  # two nodes may share a hash
    weighted = cut(join_on_hot_key(edges.withColumn("key", key), degree.select(key.alias("key"), "out", F.col("kind").alias("__kind"), F.col("src").alias("__node")), "key").where(same).drop("key", "__kind", "__node"))
    restart, zero = start.select("kind", "node", F.col("seed").alias("part")), F.lit(0.0)
    score, settled = start.select("kind", "node", F.col("seed").alias("score")), False
    while not settled:
        for r in range(_CUT_EVERY):
            state = score.select(F.xxhash64("kind", "node").alias("key"), "score", F.col("kind").alias("__kind"), F.col("node").alias("__node"))
            moved = join_on_hot_key(weighted.withColumn("key", key), state, "key").where(same).select("kind", F.col("dst").alias("node"), (F.lit(damping) * F.col("score") / F.col("out")).alias("part"))
            parts = moved.union(restart).withColumn("last", zero)
            if r == _CUT_EVERY - 1:
                parts = parts.union(score.select("kind", "node", zero, "score"))
            score = parts.groupBy("kind", "node").agg(F.sum("part").alias("score"), F.sum("last").alias("last"))
        score = cut(score)
        settled = score.where(F.col("score") - F.col("last") > F.lit(tolerance) * F.col("score")).isEmpty()
    return score.select("kind", "node", "score")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parents: bool = False) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page.

    The rule's verdict holds; without a rule the host's: block if distrust exceeds trust, else
    allow, which is also the verdict for hosts no seed reaches and for pages without a host.
    Null and repeated ids are carried, a null html has no links, extra columns are ignored.
    """
    only = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    parts = with_parts(only).withColumn("said", rule_of(rules))
    ruled = parts.where("said is not null and host <> ''").groupBy("host", "said.verdict").agg(F.count("*").cast("double").alias("mass"))
    kinds = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    seeds = ruled.select(kinds.alias("kind"), F.col("host").alias("node"), "mass")
    links = cut(host_edges(parts, parents=parents))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    scores = propagate(edges, seeds)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    hosts = scores.groupBy("node").agg((part("distrust") > part("trust") * (1 + MARGIN)).alias("bad"))
    bad = hosts.where("bad").select(F.xxhash64("node").alias("key"), F.col("node").alias("bad_host"))
    joined = join_on_hot_key(parts.select("page_id", "host", "path", "said", F.xxhash64("host").alias("key")), bad, "key", "left")
    own = F.when(F.col("bad_host") == F.col("host"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("said.name").alias("rule"), F.coalesce("said.verdict", own).alias("verdict"))


def judge_sql(rules: tuple[UrlRule, ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """DuckDB SQL for judge() over pages, one step per round."""
    name = verdict = "NULL"
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        name, verdict = f"CASE WHEN {fits} THEN '{rule.name}' ELSE {name} END", f"CASE WHEN {fits} THEN '{rule.verdict}' ELSE {verdict} END"
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    steps = [
        "u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)",
        "p AS (SELECT page_id, html, " + lower.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')") + " AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u)",
        f"r AS (SELECT page_id, html, host, path, {name} AS rule, {verdict} AS said FROM p)",
        "a AS (SELECT host, unnest(regexp_extract_all(html, $p$" + _LINK + "$p$, 1)) AS dst FROM r)",
        "l AS (SELECT DISTINCT host AS src, " + lower.format("dst") + " AS dst FROM a WHERE host <> '')",
        "e AS (SELECT 'trust' AS kind, src, dst FROM l WHERE src <> dst UNION ALL SELECT 'distrust', dst, src FROM l WHERE src <> dst)",
        "w AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS fan FROM e)",
        "m AS (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host AS node, count(*)::DOUBLE AS mass FROM r WHERE said IS NOT NULL AND host <> '' GROUP BY 1, 2)",
        "s0 AS (SELECT kind, node, mass / sum(mass) OVER (PARTITION BY kind) AS score FROM m)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"s{i} AS (SELECT kind, node, sum(part) AS score FROM (SELECT w.kind, w.dst AS node, {damping} * score / fan AS part FROM w JOIN s{i - 1} s ON s.kind = w.kind AND s.node = w.src "
            f"UNION ALL SELECT kind, node, (1 - {damping}) * score FROM s0) GROUP BY 1, 2)"
        )
    steps.append(f"b AS (SELECT node FROM s{rounds} GROUP BY 1 HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > coalesce(sum(score) FILTER (kind = 'trust'), 0) * (1 + {MARGIN}))")
    return "WITH " + ", ".join(steps) + " SELECT page_id, host, path, rule, coalesce(said, CASE WHEN b.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM r LEFT JOIN b ON b.node = r.host"
