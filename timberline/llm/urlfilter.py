"""URL filters: fixed host rules, then a path-template tree (DataFrame functions only).

Paths are cut into segments; numbers, ids and very long segments become ``*``.
Each host is a tree of segments, opened level by level below nodes whose labels
are of both kinds or do not cover all their URLs. There, branches with enough
labels whose bad share does not differ significantly from the node's are pooled,
significantly worse and significantly better ones make a pool each, and branches
with too few labels make one (and are one branch ``*`` where there are too many
different ones). A template is rejected if the smoothed labelled purity of its
pool, the share of bad labels there, is over a threshold. What smooths it is the
estimate of the node above, in proportion to the share of that node's URLs that
have labels; above a host stands its registered domain and above that a prior.
So a branch without labels is judged by its parent as far as the parent is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import cut

#: (rule, verdict) of the fixed list.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Different constant segments below one node from which those with few labels become ``*``.
MAX_CHILDREN = 16
MAX_SEGMENT = 24
#: Labels from which a branch is compared with its siblings and a node may be opened.
MIN_LABELS = 8
#: Bad and good labels that every template is taken to have beforehand: unproven ones stay.
PRIOR = (1.0, 3.0)
REJECT_OVER = 0.5
#: Two shares differ if their z-score is over this (5 % level).
Z = 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The pool of branches with too few labels, besides better (-1), similar (0) and worse (1) ones.
UNPROVEN = 2
_SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")), _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. The list is a parameter and becomes one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path's segments, ``*`` for those with digits or of great length, joined by ``/``; empty segments do not count."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > MAX_SEGMENT), "*").otherwise(s)), "/")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host name (its port aside); an address of digits is its own."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    return F.when(name.rlike("^[0-9.]*$"), name).otherwise(F.substring_index(name, ".", -2))


def _estimate(bads: Column, labels: Column, prior: Column) -> Column:
    return (bads + sum(PRIOR) * prior) / (labels + sum(PRIOR))


def _handed_down(purity: Column, labels: Column, urls: Column) -> Column:
    """What a node's purity says about its parts without labels: no more than the share of its URLs that have some."""
    base = PRIOR[0] / sum(PRIOR)
    return base + labels / urls * (purity - base)


def _opens() -> Column:
    return (F.col("l") >= MIN_LABELS) & ((F.col("l") < F.col("n")) | ((F.col("b") > 0) & (F.col("b") < F.col("l"))))


def template_tree(labelled: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """(host, shape, template, purity, labels) of each path shape in ``labelled`` (host, path, bad: 1, 0 or null).

    All steps work on counts of path shapes, which are combined before the
    shuffle, so a host with a third of the URLs costs no more than its shapes.
    Only nodes with at least ``MIN_LABELS`` labels that do not settle all their
    URLs alike are opened, each level from a written table, until none is left;
    paths may be of any length.
    A template ends where its node was not opened.
    """
    sums = lambda f, n="n", l="l", b="b": f.agg(F.sum("n").alias(n), F.sum("l").alias(l), F.sum("b").alias(b))  # noqa: E731, E741
    shapes = labelled.groupBy("host", shape_of(F.col("path")).alias("shape"))
    shapes = cut(shapes.agg(F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b")))
    hosts = sums(shapes.groupBy("host")).withColumn("domain", registered_domain(F.col("host")))
    domains = sums(hosts.groupBy("domain"), "dn", "dl", "db")
    known = _handed_down(_estimate(F.col("db"), F.col("dl"), F.lit(PRIOR[0] / sum(PRIOR))), F.col("dl"), F.col("dn"))
    hosts = hosts.join(domains, "domain").withColumn("purity", _estimate(F.col("b"), F.col("l"), known))
    hosts = hosts.select("host", "purity", F.col("l").alias("labels"), _handed_down(F.col("purity"), F.col("l"), F.col("n")).alias("prior"), _opens().alias("open"))
    state = cut(shapes.join(hosts, "host").withColumn("template", F.lit("")))
    done, level = state.where(~F.col("open")), 0
    while not (nodes := state.where("open")).isEmpty():
        nodes = nodes.withColumn("s", F.coalesce(F.get(F.split("shape", "/"), F.lit(level)), F.lit("")))
        kids = nodes.groupBy("host", "template", "s").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("prior").alias("prior"))
        whole = kids.groupBy("host", "template").agg(F.sum("l").alias("wl"), F.sum("b").alias("wb"), F.sum((~F.col("s").isin("", "*")).cast("int")).alias("different"))
        share, own, wide = F.col("wb") / F.col("wl"), F.col("b") / F.col("l"), F.col("different") > max_children
        few = (F.col("l") < MIN_LABELS) | (wide & (F.col("s") == "*"))
        apart = F.abs(own - share) > Z * F.sqrt(share * (1 - share) / F.col("l"))
        side = F.when(few, UNPROVEN).when(apart, F.signum(own - share)).otherwise(0).cast("int")
        kids = kids.join(whole, ["host", "template"]).withColumn("side", side)
        kids = kids.withColumn("piece", F.when((F.col("side") == UNPROVEN) & wide & (F.col("s") != ""), "*").otherwise(F.col("s")))
        pools = sums(kids.groupBy("host", "template", "side"), "pn", "pl", "pb")
        pieces = sums(kids.groupBy("host", "template", "piece")).withColumn("opens", _opens() & (F.col("piece") != "")).drop("n", "l", "b")
        kids = kids.join(pools, ["host", "template", "side"]).join(pieces, ["host", "template", "piece"])
        purity = _estimate(F.col("pb"), F.col("pl"), F.col("prior"))
        kids = kids.select("host", "template", "s", "piece", purity.alias("purity"), F.col("pl").alias("labels"), _handed_down(purity, F.col("pl"), F.col("pn")).alias("prior"), F.col("opens").alias("open"))
        state = nodes.drop("purity", "labels", "prior", "open").join(kids, ["host", "template", "s"])
        state = cut(state.withColumn("template", F.concat("template", F.lit("/"), "piece")).drop("s", "piece"))
        done, level = done.unionByName(state.where(~F.col("open"))), level + 1
    return done.select("host", "shape", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "purity", "labels")


def judge(pages: DataFrame, rules=RULES, max_children: int = MAX_CHILDREN) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row of ``pages`` (page_id, url).

    Labels are the rules' own verdicts: URLs that a rule blocks are bad, those
    it allows are good, others have none. A rule decides where one fits; the
    template's purity decides the rest. Null URLs and URLs without ``://`` have
    empty host and path and are judged like any other template; repeated rows
    stay; an empty table gives an empty frame; other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("says", says)
    tree = template_tree(parsed.select("host", "path", F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0).alias("bad")), max_children)
    # salted, for one host or template may hold a third of the rows
    tree = tree.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "purity", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    pages = parsed.withColumn("shape", shape_of(F.col("path"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(_SALTS)).cast("int"))
    on = (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")) & (F.col("salt") == F.col("_salt"))
    verdict = F.coalesce("says", F.when(F.col("purity") > REJECT_OVER, "block").otherwise("allow"))
    return pages.join(tree, on, "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 9).alias("purity"))
