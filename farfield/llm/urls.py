"""URL filters: rules on hosts and paths, and for all other pages what the link graph says of their host.

A page that a rule fits takes the verdict of the longest one. Trust starts at the pages that a rule allows and follows
the links between hosts (personalised PageRank); distrust starts at the pages that a rule blocks and follows the links
backwards. Both are counted in pages and are passed on whole. A host is blocked if its distrust is more than ``share``
of its distrust, its trust and its own pages without a rule together; without evidence it is allowed.

Nulls, a null or odd url: host and path are empty; a page without a host takes part in no link and is allowed unless a
rule fits. Null html has no links. Repeated rows count as often as they come and each gets its row; an empty table gives
an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.scratch import stored

#: (verdict, host and path). A rule fits its host and all subdomains, if the path of the url starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
SHARE = 0.5
LEFT = 1e-3  # share of the seeds' pages that may still be under way when the rounds end
ROUNDS = 100

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the host of each link that names one; possessive, so that a page costs one pass
_LINK = r"(?i)[\s\"'](?:href|src|action|cite|data)\s*+=\s*+[\"']?\s*+(?:https?:)?//([^/?#\"'\s<>]++)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*+([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null; of equally long ones the first given."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): n pages of host src have a link to host dst. Links within a host don't count."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER)))
    each = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(targets).alias("dst"))
    return each.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, left: float = LEFT, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust: pages that start there) over ``edges`` (src, dst, n).

    Trust goes from src to dst, dealt out by the counts of src; distrust goes from dst to src, dealt out by the counts
    of dst. What reaches a host without a way on starts anew at the seeds, so that the sums stay those of the seeds.
    Rounds pass on only what came in the round before; they end once less than ``left`` of it all is under way.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = stored(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("ahead"), (F.col("n") / F.col("into")).alias("back")), "links")
    both = ("trust", "distrust")
    total = seeds.agg(*(F.sum(c).alias(c) for c in both)).first()
    moving = seeds
    parts = [seeds]
    for _ in range(rounds):
        ahead = edges.join(moving.where("trust > 0"), F.col("src") == F.col("host")).select(F.col("dst").alias("to"), (damping * F.col("trust") * F.col("ahead")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(moving.where("distrust > 0"), F.col("dst") == F.col("host")).select(F.col("src").alias("to"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") * F.col("back")).alias("distrust"))
        moving = stored(ahead.union(back).groupBy("to").agg(*(F.sum(c).alias(c) for c in both)).withColumnRenamed("to", "host"), "moving")
        now = moving.agg(*(F.sum(c).alias(c) for c in both)).first()
        parts.append(moving)
        if all((now[c] or 0) <= left * (total[c] or 0) for c in both):
            break
        if len(parts) == 16:
            parts = [_summed(parts)]
    reached = _summed(parts)
    sums = reached.agg(*(F.sum(c).alias(c) for c in both)).first()
    return reached.select("host", *((F.col(c) * ((total[c] or 0) / sums[c] if sums[c] else 0.0)).alias(c) for c in both))


def _summed(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return stored(every.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "reached")


def host_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, share: float = SHARE) -> DataFrame:
    """(host, pages, open, trust, distrust, verdict) of each host that has a page; open: its pages without a rule."""
    judged = _judged(pages, rules)
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("rule").isNull()).alias("open"),
        F.count_if(F.col("said") == "allow").cast("double").alias("trust"), F.count_if(F.col("said") == "block").cast("double").alias("distrust"),
    )
    hosts = stored(hosts, "hosts")
    edges = stored(links(pages), "edges")
    if not edges.isEmpty():
        scores = propagate(hosts.select("host", "trust", "distrust").where("trust > 0 or distrust > 0"), edges)
        hosts = hosts.select("host", "pages", "open").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > share * (F.col("distrust") + F.col("trust") + F.col("open"))
    return hosts.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def _judged(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    found = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("said"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, share: float = SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, html).

    Only the hosts that are blocked and have a page without a rule are joined, so that a host with a large part of all
    pages is no hot key unless it is blocked by its links; then Spark splits its rows, as the other side has one a host.
    """
    blocked = stored(host_verdicts(pages, rules, share).where("verdict = 'block' and open > 0").select(F.col("host").alias("bad_host")), "blocked")
    rows = _judged(pages, rules).join(blocked, F.col("rule").isNull() & (F.col("host") == F.col("bad_host")), "left")
    by_method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"))
