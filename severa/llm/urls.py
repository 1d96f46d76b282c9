"""URL filters: host and path rules, and link-graph propagation for the hosts that no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.llm.common import small, written

#: Rules up to so many become one expression; more are joined by host suffix.
RULES_IN_PLAN = 200
DAMPING = 0.85
#: Scores are tested after every ROUNDS rounds, and are done when none grew by more than SETTLED of itself in the last.
ROUNDS = 12
SETTLED = 1e-4
#: A host's pages without a rule are blocked if its distrust is over RATIO times its trust and over LEAST. A host that is
#: wholly a seed starts with a score of 1 - DAMPING, whatever the crawl's size.
RATIO = 1.0
LEAST = 1e-4

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Links that a page writes with a host, from the slashes on, with or without a scheme: in any attribute, <base> among
#: them, or in its text.
LINKS = r"//[^\x00-\x20\"'<>\\]+"
#: Names of hosts that a page writes out, such as in a footer.
NAMED = r"(?<![A-Za-z0-9._@-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _split_rule(rule: str) -> tuple[str, str]:
    """A rule's host and path: `net/es/` is net and /es/."""
    name, slash, rest = rule.partition("/")
    return name.lower(), slash + rest


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages with host and path -> with rule and says (its verdict), the longest rule that fits, else nulls.

    rules: (verdict, rule). A rule fits its host and all subdomains where the path starts with its path. Of rules of
    one length the first in code point order wins.
    """
    order = sorted({(r, v) for v, r in rules}, key=lambda x: (-len(x[0]), x))
    if len({r for r, _ in order}) < len(order):
        raise ValueError("a rule has two verdicts")
    if len(order) > RULES_IN_PLAN:
        return _joined(pages, order)
    fits = []
    for rule, verdict in order:
        h, p = _split_rule(rule)
        fit = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("says"))))
    best = F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,says:string>")
    return pages.withColumn("_best", best).select("*", "_best.rule", "_best.says").drop("_best")


def _joined(pages: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """ruled() for long lists: each distinct host and path meets the rules of its host's suffixes."""
    spark = pages.sparkSession
    rows = [(*_split_rule(rule), i, rule, verdict) for i, (rule, verdict) in enumerate(order)]
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, at int, rule string, says string")
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    places = pages.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(small(table), "rule_host").where("startswith(path, rule_path)")
    best = met.groupBy("host", "path").agg(F.min_by(F.struct("rule", "says"), "at").alias("_best"))
    return pages.join(written(best, "best"), ["host", "path"], "left").select(*pages.columns, "_best.rule", "_best.says")


def node(name: Column) -> Column:
    """A host as a node of the link graph: without user and port."""
    return F.regexp_replace(name, r"^.*@|:[0-9]*$", "")


def mentions(pages: DataFrame) -> DataFrame:
    """Distinct (src, kind, what) of pages (host, html): what they write of links with a host (kind link, a url of http) and
    of hosts' names (kind name). Both are taken in one pass."""
    html = F.coalesce(F.col("html"), F.lit(""))
    found = lambda pattern, kind, make: F.transform(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))), lambda x: F.struct(F.lit(kind).alias("kind"), make(x).alias("what")))
    both = F.concat(found(LINKS, "link", lambda x: F.concat(F.lit("http:"), x)), found(NAMED, "name", lambda x: F.translate(x, UPPER, UPPER.lower())))
    return pages.where("host <> ''").select(node(F.col("host")).alias("src"), F.explode(both).alias("m")).select("src", "m.kind", "m.what").distinct()


def graph(pages: DataFrame, rules: list[tuple[str, str]], told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, seeds) of pages (host, html); told are their ruled() rows, by host.

    edges (src, dst) join different hosts, crawled or not: a page of src links to dst, or writes out its name if dst was
    crawled. seeds (host, allowed, blocked) are shares, from 0 to 1, of a host's urls that rules allow and block: of its
    own pages, and of the distinct links to it that other hosts write.
    """
    said = written(mentions(pages), "mentions")
    there = said.where("kind = 'link'").select("src", host(F.col("what")).alias("host"), path(F.col("what")).alias("path")).where("host <> ''")
    judged = written(ruled(there, rules).select("src", node(F.col("host")).alias("dst"), "says").where("dst <> '' and src <> dst"), "judged")
    own = told.where("host <> ''").select(node(F.col("host")).alias("host"), "says")
    crawled = written(own.select("host").distinct(), "hosts")
    names = said.where("kind = 'name' and src <> what").select("src", F.col("what").alias("dst"))
    named = names.join(small(crawled.select(F.col("host").alias("dst"))), "dst", "left_semi").select("src", "dst")
    edges = judged.select("src", "dst").union(named).distinct()
    says = lambda x: F.count_if(F.col("says") == x) / F.count("*")
    seeds = own.union(judged.select("dst", "says")).groupBy("host").agg(says("allow").alias("allowed"), says("block").alias("blocked"))
    return written(edges, "edges"), written(seeds.where("allowed > 0 or blocked > 0"), "seeds")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from allowed seeds along edges, and from blocked ones against them.

    seeds are (host, allowed, blocked), shares from 0 to 1; a whole seed starts with 1 - damping. That is PageRank times
    the number of seeds, so trust and distrust compare host by host, and neither depends on how many seeds there are.
    Both run as one table: a row's kind tells which. Each round is one join on the written edges and one sum that
    combines before the shuffle; a host that all link to is a sum, one that links to all a join that Spark can split.
    Rounds go on until all that a seed reaches has a score and none still grows by more than settled of itself; that is
    tested after every so many rounds. Hosts that no seed reaches don't come back. Mass at hosts without a way on is lost, as in a walk that ends there.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    ways = written(forward.union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"))), "ways")
    degrees = written(ways.groupBy("kind", "a").agg(F.count("*").alias("n")), "degrees")
    ways = written(ways.join(degrees, ["kind", "a"]).select("kind", "a", "b", (F.lit(damping) / F.col("n")).alias("share")), "shares", (ways, degrees))
    begin = lambda kind, share: seeds.where(f"{share} > 0").select(F.lit(kind).alias("kind"), "host", ((1 - damping) * F.col(share)).alias("score"))
    start = written(begin("trust", "allowed").union(begin("distrust", "blocked")).withColumn("was", F.lit(0.0)), "base")
    none = F.lit(0.0)
    state, growing = start, not (ways.isEmpty() or start.isEmpty())
    while growing:
        for _ in range(rounds):
            sent = ways.join(state, (ways["kind"] == state["kind"]) & (ways["a"] == state["host"])).select(ways["kind"], F.col("b").alias("host"), (F.col("share") * F.col("score")).alias("score"), none.alias("was"))
            before = state.select("kind", "host", none.alias("score"), F.col("score").alias("was"))
            after = sent.union(start).union(before).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
            state = written(after, "state", () if state is start else (state,))
        growing = not state.where(F.abs(F.col("score") - F.col("was")) > settled * F.col("score")).isEmpty()
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return state.groupBy("host").agg(part("trust"), part("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], ratio: float = RATIO, least: float = LEAST) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule and verdict.

    A page that a rule fits has the rule's verdict. Others have their host's, by its scores from graph() and propagate():
    block where distrust is over ratio times trust and over least, else allow. A null url, or one without ://, has an
    empty host and path, and is allowed by no link. Repeated rows come back repeated; null html has no links, html of
    any length is read whole; an empty table gives an empty one; other columns are ignored. Without an edge a host's scores
    are its own pages' shares alone.
    """
    placed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    told = ruled(placed, rules)
    edges, seeds = graph(pages.select(host(F.col("url")).alias("host"), "html"), rules, told)
    scores = propagate(edges, seeds)
    bad = written(scores.where((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > least)).select(F.col("host").alias("_node"), F.lit("block").alias("propagated")), "bad")
    out = told.withColumn("_node", node(F.col("host"))).join(small(bad), "_node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", "propagated", F.lit("allow")).alias("verdict"))
