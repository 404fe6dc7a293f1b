"""URL filter with link-graph propagation.

Rules judge the urls they fit. For the rest, trust flows from trusted hosts along
host links (personalised PageRank), and distrust flows from blocked hosts against
the links: who links to blocked hosts is suspect. A blocked host's distrust is divided
among all that link to it, so a host's own links are weighed as well: the part of its
walks that ends at blocked hosts, however many others link there. A host whose distrust,
the greater of both, exceeds its trust by the threshold is blocked. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import stash


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Params:
    """``seed_share``: a host of whose pages more than this share is judged alike by rules is a seed.
    ``threshold``: by how much a host's distrust may exceed its trust; a seed that nothing
    links to has 1 - damping. ``tolerance``: propagation ends when a round adds less than this
    to all hosts together; ``rounds`` ends it earlier, if given."""

    damping: float = 0.85
    rounds: int | None = None
    tolerance: float = 1e-4
    seed_share: float = 0.9
    threshold: float = 0.05
    rules: tuple[Rule, ...] = RULES


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest comes last and so stands first in the chain
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


# Comments; elements whose contents are text; an attribute; a tag up to the value of its first href, which is the match's end.
_COMMENT = r"(?s)<!--(?:>|->|.*?(?:--!?>|\z))"
_RAW = r"(?is)<(script|style|template|textarea|title|iframe|noembed|noframes|xmp)\b.*?(?:</\1(?=[\s/>])|\z)"
_ATTRIBUTE = r"""[^\s=/>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_TO_HREF = r"""(?i)<(?:{0})(?:[\s/]++(?!href[\s=])""" + _ATTRIBUTE + r""")*+[\s/]++href\s*+=\s*+["']?+"""
_VALUE = r"""(?:(?<=")[^"]*+|(?<=')[^']*+|(?<![\"'])[^\s"'>]++)"""


def _target(tag: Column, prefix: str, base: Column | None = None) -> Column:
    """The host that a tag's href leads to: its own, after ``//`` as after a scheme, else that of ``base``; null without one."""
    value = F.trim(F.regexp_replace(tag, "^" + prefix, ""))
    absolute = F.when(value.startswith("//"), host_of(F.concat(F.lit("x:"), value))).when(value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), host_of(value))
    if base is None:
        return absolute
    return absolute.when(~value.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|#|$)"), base)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of the links between different hosts, from ``host`` and ``html``: the href of ``a`` and ``area`` elements outside of
    comments, scripts and the like, whatever other attributes hold; relative ones lead to the host of the page's ``base``."""
    link, base = _TO_HREF.format("a|area"), _TO_HREF.format("base")
    text = F.regexp_replace(F.regexp_replace("html", _COMMENT, ""), _RAW, "")
    tags = pages.filter("host != ''").select(F.col("host").alias("src"), text.alias("text"))
    links = tags.select("src", _target(F.regexp_extract("text", base + _VALUE, 0), base).alias("base"),
                        F.explode(F.regexp_extract_all("text", F.lit(link + _VALUE), F.lit(0))).alias("tag"))
    return (links.select("src", _target(F.col("tag"), link, F.col("base")).alias("dst")).filter("dst != '' AND dst != src")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(seeds: DataFrame, links: DataFrame, p: Params, of: str = "src") -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host) along ``links`` (src, dst, n).

    Every seed has 1 - damping; each round adds the walks that are a link longer. Mass of hosts without links ends there.
    ``of``: whose links a link's share is taken of; with "dst" a score is the damped mean of those that link here, not a part of each."""
    out = links.groupBy(F.col(of).alias("whose")).agg(F.sum("n").alias("all"))
    shares = stash(links.join(out, F.col(of) == F.col("whose")).select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    start = seeds.select("host", F.lit(1.0).alias("seed"))
    score = start.select("host", (F.lit(1 - p.damping) * F.col("seed")).alias("score"))
    if shares.isEmpty():
        return score
    total = score.agg(F.sum("score")).first()[0] or 0.0
    done = 0
    while total and (p.rounds is None or done < p.rounds):
        moved = (score.join(shares, score.host == shares.src).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("moved")))
        score = (start.join(moved, start.host == moved.dst, "full")
                 .select(F.coalesce("host", "dst").alias("host"),
                         (F.lit(1 - p.damping) * F.coalesce("seed", F.lit(0.0)) + F.lit(p.damping) * F.coalesce("moved", F.lit(0.0))).alias("score")))
        score = stash(score, f"rank{done}")
        # No score ever falls, so the sum grows by all that has changed.
        before, total, done = total, score.agg(F.sum("score")).first()[0], done + 1
        if total - before < p.tolerance:
            break
    return score


def host_verdicts(pages: DataFrame, links: DataFrame, p: Params) -> DataFrame:
    """(host, trust, distrust, host_verdict) from ``pages`` (host, rule_verdict) and ``links``; distrust is the greater of both measures."""
    share = pages.filter("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    share = stash(share, "hosts")
    trust = propagate(share.filter(F.col("allowed") > F.col("n") * p.seed_share).select("host"), links, p)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    blocked = share.filter(F.col("blocked") > F.col("n") * p.seed_share).select("host")
    received = propagate(blocked, back, p).withColumnRenamed("score", "received")
    own = propagate(blocked, back, p, of="dst").withColumnRenamed("score", "own")
    both = (share.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left")
            .join(received, "host", "left").join(own, "host", "left")
            .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce(F.greatest("received", "own"), F.lit(0.0)).alias("distrust")))
    bad = F.col("distrust") - F.col("trust") > p.threshold
    return both.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    Null urls and urls without ``://`` have empty host and path, fit no rule and are
    allowed (there is no host to distrust). Null or empty html has no links. Repeated
    rows count as often as they stand. An empty table gives an empty result; other
    columns are not looked at.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = judged(F.col("host"), F.col("path"), p.rules)
    urls = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict")))
    urls = stash(urls, "urls")
    links = stash(host_links(pages.select(host.alias("host"), "html")), "links")
    hosts = host_verdicts(urls, links, p).select(F.col("host").alias("of_host"), "host_verdict")
    # A host may have a third of all pages; the rows are narrow, and adaptive execution splits such a key or broadcasts a small side.
    return (urls.join(hosts, F.col("host") == F.col("of_host"), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict")))
