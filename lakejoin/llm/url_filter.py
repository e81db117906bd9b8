"""URL filter by a path-template tree (DataFrame functions only).

Fixed rules (host suffix, path prefix, verdict) decide the urls they fit and
label them.  Other urls are judged by the tree:

1. *Templates.*  Path segments of digits, hexadecimal ids and the like become
   wildcards by shape.  Level by level, under each host and template so far, a
   segment that holds too small a share of its parent's pages becomes ``*``,
   unless its labelled share differs from its siblings' (the test of 3., with
   SUPPORT labelled pages or more).  Levels are added until no node of a host
   holds both blocked and allowed labels above longer paths; what is deeper is ``**``.
2. *Purity.*  Each node counts labelled pages and blocked ones.  The chance of
   ``block`` at a node is smoothed towards its parent:
   (blocked + K * parent) / (labelled + K).
3. *Merging.*  A branch whose labelled share does not differ from its parent's
   (two-proportion test, |z| < Z) takes the parent's value.
4. A url is blocked if its leaf's value is 0.5 or more.

A host without labelled pages starts from the same template over all hosts,
that from the overall share.  All statistics are sums over distinct (host,
template) rows, pre-aggregated, so a host with a third of all pages is one row
a template; pages meet the result in one join, whose hot keys AQE can split.

Edge cases: a null url or one without ``://`` has an empty host and path, and
is judged like any host; without labelled pages everything is allowed; repeated rows and
null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared

LEVELS = 4            # levels at least; more where labels still differ below
MIN_SHARE = 0.02      # smaller segments become wildcards if their labels are like their siblings'
SMOOTH = 4.0
SUPPORT = 4           # with fewer labelled pages than SMOOTH a node stays nearer to its parent
Z = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Longest fitting rule text of [(verdict, "host/path"), ...]; null if none."""
    out = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _shape(seg: Column) -> Column:
    """Wildcards by shape: numbers, hexadecimal ids, both with a file ending."""
    seg = F.regexp_replace(seg, r"^[0-9]+(?=\.[A-Za-z]+$|$)", "{n}")
    return F.regexp_replace(seg, r"^(?=[^.]*[0-9])[0-9A-Fa-f-]{8,}(?=\.[A-Za-z]+$|$)", "{h}")


def _same() -> Column:
    """Two-proportion test of a node (nb of nn labelled pages blocked) against the
    rest of its parent (ub of un)."""
    div = F.try_divide
    pool = div("ub", "un")
    rest = F.col("un") - F.col("nn")
    diff = div("nb", "nn") - div(F.col("ub") - F.col("nb"), rest)
    z = div(F.abs(diff), F.sqrt(pool * (1 - pool) * (div(F.lit(1.0), F.col("nn")) + div(F.lit(1.0), rest))))
    return F.coalesce(z < Z, F.lit(True))      # null: no labelled pages here or elsewhere, or one kind only


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and p_block."""
    cols = pages.columns
    names = {n: shared.fresh(cols, n) for n in ("host", "path", "rule", "verdict", "template", "p_block", "raw")}
    n = names
    df = pages.withColumn(n["host"], host_of(F.col(url_col))).withColumn(n["path"], path_of(F.col(url_col)))
    df = df.withColumn(n["rule"], rule_of(F.col(n["host"]), F.col(n["path"]), rules))
    block = [t for v, t in rules if v == "block"]
    segs = F.transform(F.filter(F.split(n["path"], "/", -1), lambda s: s != ""), _shape)
    df = df.withColumn(n["raw"], F.array_join(segs, "/"))
    # distinct (host, shaped path), with its labelled and blocked pages
    s = F.split("raw", "/", -1)
    leaves = (df.select(F.col(n["host"]).alias("host"), F.col(n["raw"]).alias("raw"), F.col(n["rule"]).alias("rule"))
              .groupBy("host", "raw").agg(F.count("*").alias("pages"), F.count("rule").alias("n"),
                                          F.count(F.when(F.col("rule").isin(block), 1)).alias("b")))
    leaves = shared.staged(leaves)
    longest = leaves.agg(F.max(F.size(s))).first()[0] or 0
    path_t: list[str] = []

    def divided(below: DataFrame) -> bool:
        """Does a node of one host hold both kinds of labels above longer paths?  Hosts
        that differ from each other are told apart without any level."""
        deep = F.max(F.size(s) > len(path_t))
        return bool(below.groupBy("host", *path_t).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), deep.alias("deep"))
                    .filter("deep and 0 < b and b < n").limit(1).count())

    while len(path_t) < LEVELS or len(path_t) < longest and divided(leaves):
        i, up = len(path_t), ["host", *path_t]
        leaves = leaves.withColumn(f"s{i}", F.coalesce(F.get(s, F.lit(i)), F.lit("")))
        # share of the segment among its parent's pages, and of blocked ones among the labelled
        seg = leaves.groupBy(*up, f"s{i}").agg(F.sum("pages").alias("own"), F.sum("n").alias("nn"), F.sum("b").alias("nb"))
        parent = leaves.groupBy(*up).agg(F.sum("pages").alias("all"), F.sum("n").alias("un"), F.sum("b").alias("ub"))
        differs = (F.col("nn") >= SUPPORT) & ~_same()
        lit = (seg.join(parent, up).select(*up, f"s{i}", F.when(
            (F.col(f"s{i}") == "") | F.col(f"s{i}").startswith("{") | (F.col("own") >= MIN_SHARE * F.col("all")) | differs,
            F.col(f"s{i}")).otherwise("*").alias(f"t{i}")))
        leaves = shared.staged(leaves.join(lit, [*up, f"s{i}"]))      # narrow; keeps the plan short
        path_t.append(f"t{i}")
    leaves = leaves.withColumn("tail", F.when(F.size(s) > len(path_t), "**").otherwise(""))
    total = leaves.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b0"), F.coalesce(F.sum("n"), F.lit(0)).alias("n0")) \
        .select("b0", "n0", (F.col("b0") / (F.col("n0") + 1)).alias("p0")).first()       # one row
    smooth = lambda b, k, p: (b + F.lit(SMOOTH) * p) / (k + F.lit(SMOOTH))
    # the same template over all hosts
    node = (leaves.groupBy(*path_t).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
            .select(*path_t, smooth(F.col("b"), F.col("n"), F.lit(float(total["p0"]))).alias("p_any")))
    cur = leaves.groupBy("host", *path_t).agg(F.sum("b").alias("b"), F.sum("n").alias("n")).join(node, path_t)
    # down the host's own tree: host, host/t0, host/t0/t1, ...
    p = F.col("p_any")
    cur = cur.withColumn("p", p)
    for depth in range(len(path_t) + 1):
        own = ["host", *path_t[:depth]]
        stats = cur.groupBy(*own).agg(F.sum("b").alias("nb"), F.sum("n").alias("nn"))
        cur = cur.join(stats, own)
        if depth == 0:
            same = F.col("nn") == 0
        else:
            same = _same()
        cur = cur.withColumn("p", F.when(same, F.col("p")).otherwise(smooth(F.col("nb"), F.col("nn"), F.col("p"))))
        if depth:
            cur = cur.drop("ub", "un")
        cur = shared.staged(cur.withColumnsRenamed({"nb": "ub", "nn": "un"}))
    verdicts = (leaves.join(cur.select("host", *path_t, "p"), ["host", *path_t])
                .select(F.col("host").alias(n["host"]), F.col("raw").alias(n["raw"]),
                        F.concat(F.lit("/"), F.array_join(F.filter(F.array(*path_t, "tail"), lambda x: x != ""), "/")).alias(n["template"]),
                        F.col("p").alias(n["p_block"])))
    verdicts = shared.staged(verdicts)
    out = df.join(verdicts, [n["host"], n["raw"]], "left")
    by_rule = F.when(F.col(n["rule"]).isin(block), "block").otherwise("allow")
    out = out.withColumn(n["verdict"], F.when(F.col(n["rule"]).isNotNull(), by_rule).otherwise(
        F.when(F.col(n["p_block"]) >= 0.5, "block").otherwise("allow")))
    return out.select(*cols, *[n[x] for x in ("host", "path", "rule", "verdict", "template", "p_block")])
