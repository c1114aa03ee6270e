"""URL filters: rules by host and path, and trust propagated over the links between hosts.

Where a rule fits, the longest decides.  For other urls the host decides: personalised PageRank
spreads trust along links from hosts that rules mostly allow, and distrust against links (to those
who link there) from hosts that rules mostly block.  Besides the pages' links, a host and the
domain above it are taken to link to each other, and so on up to the domain of two labels.  A host is blocked where its distrust is above
both its trust and ``threshold`` times an even share.

Links are counted per pair of hosts before anything is joined; ranks, edges and hosts stay in
tables, and each step is one join and one aggregate on hosts.  A step brings ranks nearer to their
fixed point by ``DAMPING`` at least, so ``STEPS`` steps leave a total error below ``SETTLED``,
whatever the graph.  Only counts reach the driver.

Defined results: a null url, or one without ``://``, has an empty host and path, takes no rule and
is allowed; null or empty html has no links; repeated rows get equal verdicts, and their links
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import BROADCAST_IDS, Scratch, checkpointed

#: (host, path, verdict): fits the host and its subdomains where the url's path starts so.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-6, 0.5
STEPS = math.ceil(math.log(SETTLED / 2) / math.log(DAMPING))  # two distributions differ by 2 at most
#: Steps that one plan holds; their result is written before the next plan.
CUT_EVERY = 8
#: Rules that are written into the plan; more of them are joined.
INLINE_RULES = 200

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_AZ), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_by_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``df`` (host, path, ...) with ``rule`` and ``rule_verdict``; null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    if len(ranked) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for host, path, says in reversed(ranked):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
        return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    table = df.sparkSession.createDataFrame(ranked, "rule_host string, rule_path string, says string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    seen = df.select("host", "path").distinct()
    fits = seen.withColumn("rule_host", F.explode(above)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), F.col("says").alias("rule_verdict")), F.struct(F.length(name), name)).alias("best"))
    return df.join(best.select("host", "path", "best.*"), ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: ``src``, ``dst`` and how many; ``pages``: host, url, html."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    linked = links.select("src", host_of(to).alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    above = pages.where("host <> ''").select("host").distinct().select(chain.alias("chain")).where(F.size("chain") > 1)
    pair = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.get("chain", i - 1).alias("src"), F.get("chain", i).alias("dst")))
    kin = above.select(F.explode(pair).alias("k")).select("k.*").distinct()
    kin = kin.unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1.0))
    return linked.unionByName(kin).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, trust, distrust``; seeds: ``host, kind`` (``trust`` or ``distrust``)."""
    with Scratch(edges.sparkSession) as scratch:
        return _propagated(edges, seeds, scratch)


def _propagated(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "at").agg(F.sum("n").alias("out"))
    flow = scratch.put(both.join(out, ["kind", "at"]).select("kind", F.col("at").alias("host"), "to", (F.col("n") / F.col("out")).alias("share")))
    size = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    start = scratch.put(seeds.join(F.broadcast(size), "kind").select("kind", "host", (F.lit(1.0) / F.col("size")).alias("rank")))
    base = start.select("kind", "host", ((1 - DAMPING) * F.col("rank")).alias("rank"))
    rank, held = start, None
    for i in range(1, STEPS + 1):
        moved = rank.join(flow, ["kind", "host"]).select("kind", F.col("to").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
        rank = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % CUT_EVERY == 0 or i == STEPS:
            rank = scratch.put(rank)
            scratch.drop(held)
            held = rank
    return checkpointed(_both(rank))


def _both(rank: DataFrame) -> DataFrame:
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row of ``pages`` (page_id, url, html)."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = judged_by_rules(parsed, rules)
    said = lambda v: F.count(F.when(F.col("rule_verdict") == v, 1))
    counts = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), said("allow").alias("allowed"), said("block").alias("blocked"))
    kind = F.when(2 * F.col("allowed") > F.col("n"), "trust").when(2 * F.col("blocked") > F.col("n"), "distrust")
    seeds = checkpointed(counts.select("host", kind.alias("kind")).where("kind is not null"))
    edges = checkpointed(host_edges(parsed))
    ranks = propagate(edges, seeds)
    nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct().count()
    blocked = checkpointed(ranks.withColumn("bad", (F.col("distrust") > F.col("trust")) & (F.col("distrust") * max(nodes, 1) > threshold)))
    few = F.broadcast(blocked) if blocked.count() <= BROADCAST_IDS else blocked
    done = judged.drop("html").join(few, "host", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return done.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
