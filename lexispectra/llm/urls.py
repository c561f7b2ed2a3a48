"""URL filters: rules by host and path, and trust and distrust along links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispectra.runtime import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Share of a host's score that its links hand on, the part of a walk below which it is over, and the surplus of distrust that blocks a host.
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)\shref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits (the first of equally long ones), as a struct of rule and verdict; else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Links between different hosts of pages with column ``host``: src, dst, n."""
    linked = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))
    found = pages.where(F.col("host") != "").select(F.col("host").alias("src"), linked.alias("dst"))
    edges = found.withColumn("dst", F.translate("dst", UPPER, LOWER))
    return edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: walk, host, and a score for each other column of ``seeds`` (walk, host, ...).

    ``links`` are (walk, src, dst, n). A step hands ``damping`` of what reached a host in the step before to
    the hosts it links to, by number of links; what comes to a host without links ends there. The score is
    the sum over all steps, from (1 - damping) of the seeds on, so it does not depend on the number of
    hosts. The steps end when no host gets ``tolerance`` any more, and exactly where no way goes on. Each
    is a join on the source and a sum by target, combined before its shuffle.
    """
    names = [c for c in seeds.columns if c not in ("walk", "host")]
    total = links.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    shares = stage(links.join(total, ["walk", "src"]).select("walk", "src", "dst", (damping * F.col("n") / F.col("total")).alias("share")), "links")
    step = stage(seeds.select("walk", "host", *[((1 - damping) * F.col(c)).alias(c) for c in names]), "walk")
    steps = step
    while True:
        handed = shares.join(step.withColumnRenamed("host", "src"), ["walk", "src"])
        handed = handed.groupBy("walk", F.col("dst").alias("host")).agg(*[F.sum(F.col("share") * F.col(c)).alias(c) for c in names])
        step = stage(handed, "walk")
        most = step.agg(*[F.max(c) for c in names]).first()
        if max((x or 0.0 for x in most), default=0.0) < tolerance * (1 - damping):
            return steps.groupBy("walk", "host").agg(*[F.sum(c).alias(c) for c in names])
        steps = steps.unionByName(step)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """host, path, rule and verdict of every row.

    A page's rule decides; other pages follow their host. A host is a seed of trust
    by the share of its pages that rules allow, of distrust by the share that they
    block; trust flows along links, distrust against them. Both are taken relative to the score that the host would
    have if all pages of all hosts with a rule were allowed, or blocked, so each is a share from 0 to 1, however
    many hosts there are. A host whose distrust exceeds its trust by ``threshold`` is blocked. Hosts that
    no judged host reaches are allowed, as are rows without a host; a null page has no links, repeated rows are
    judged alike. The verdicts come back to the pages by a join on the host, whose hot keys adaptive execution splits.
    """
    parsed = pages.select(F.col(id_col).alias(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("_html"))
    ruled = parsed.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("_rule.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = stage(ruled.where(F.col("host") != "").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), "hosts")
    links = stage(host_links(ruled.withColumnRenamed("_html", "html"), "html"), "links")
    back = links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = links.select(F.lit("trust").alias("walk"), "src", "dst", "n").unionByName(back)
    judged = hosts.where((F.col("allow") > 0) | (F.col("block") > 0))
    seeds = [judged.select(F.lit(walk).alias("walk"), "host", F.col(own).alias("part"), F.lit(1.0).alias("whole")) for walk, own in (("trust", "allow"), ("distrust", "block"))]
    found = propagate(both, seeds[0].unionByName(seeds[1])).select("walk", "host", F.round(F.col("part") / F.col("whole"), 9).alias("score"))
    found = found.groupBy("host").pivot("walk", ["trust", "distrust"]).agg(F.first("score"))
    light = ruled.select(id_col, "host", "path", "_rule").join(found, "host", "left")
    light = light.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    blocked = F.col("distrust") - F.col("trust") >= threshold
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(blocked, "block").otherwise("allow"))
    return light.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
