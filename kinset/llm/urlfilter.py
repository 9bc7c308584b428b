"""URL filters: stated rules first, then a tree of path templates for each host.

The rules label the pages that they fit. The other pages are judged by templates that are
learned from all pages. For each host a tree is grown over the segments of the paths, level
by level. At a node, a segment value with few of the node's pages is a variable and becomes
the wildcard ``*``. Of the remaining branches those whose labels do not differ from those of
the rest of the node (a chi-square test of two by two counts) are merged into the wildcard,
too. A path deeper than ``DEPTH`` ends in ``**``, which stands for all that follows. Each
template gets the share of blocked pages among its labelled ones, smoothed towards its
host's share, which is smoothed towards that of all pages; templates of at least ``REJECT``
are rejected.

Everything is DataFrame code. Pages are first counted by (host, path), so copies of a URL
are one row in the tree. A level counts branches with map-side sums; branches that can never
be kept are dropped before they meet their node; only joins that can be split carry rows of
one host. No table is collected.

Edge cases. A null URL or one without ``://`` has the empty host and path, a tree of its own
with no segments. Repeated rows and repeated ids each get their row. Empty segments are
skipped by the tree. Equal tests and shares have no ties: every branch is decided alone. An
empty table gives an empty result; without any label every template gets the share 1/2 of
the uninformed prior and is kept. Columns of pages stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm.common import fresh, release, stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins so.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

DEPTH = 6
#: A segment value stays a branch of its own with at least so many pages of its node ...
LEAST = 5
#: ... and one in so many of the node's pages.
ONE_IN = 50
#: Chi-square with one degree of freedom at the level 0.05.
DIFFERS = 3.841
#: Pages that a smoothed share takes from the level above.
PRIOR = 4.0
REJECT = 0.5

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and / ? # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, fields null where none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, name, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        out = F.when(fits, F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the counts ((a, b), (c, d)); null where a row or a column is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    gap, rest = a * d - b * c, (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(rest > 0, gap * gap * (a + b + c + d) / rest)


def _branches(urls: DataFrame) -> DataFrame:
    """(host, template, segment) of the branches of this level that stay on their own."""
    sums = [F.sum(c).alias(c) for c in ("n", "allow", "block")]
    child = stored(urls.where("segment is not null").groupBy("host", "template", "segment").agg(*sums), "branches")
    node = child.groupBy("host", "template").agg(*[F.sum(c).alias("all_" + c) for c in ("n", "allow", "block")])
    both = child.where(F.col("n") >= LEAST).join(node, ["host", "template"]).where(F.col("n") * ONE_IN >= F.col("all_n"))
    rest_allow, rest_block = F.col("all_allow") - F.col("allow"), F.col("all_block") - F.col("block")
    differs = chi_square(F.col("allow"), F.col("block"), rest_allow, rest_block) >= DIFFERS
    alone = (F.col("allow") + F.col("block") > 0) & (rest_allow + rest_block == 0)
    return both.where(F.coalesce(differs, F.lit(False)) | alone).select("host", "template", "segment"), child


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, path, n, allow, block, template) from distinct (host, path, n, allow, block)."""
    segments = F.regexp_extract_all("path", F.lit("[^/]+"), F.lit(0))
    now = stored(urls.withColumn("segments", segments).withColumn("template", F.lit("")), "urls")
    deepest = now.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    for level in range(min(depth, deepest)):
        here = now.withColumn("segment", F.get("segments", F.lit(level)))
        kept, child = _branches(here)
        joined = here.join(kept.withColumn("own", F.lit(True)), ["host", "template", "segment"], "left")
        step = F.when(F.col("own"), F.concat(F.lit("/"), F.col("segment"))).when(F.col("segment").isNotNull(), F.lit("/*")).otherwise(F.lit(""))
        grown = stored(joined.withColumn("template", F.concat("template", step)).drop("segment", "own"), "urls")
        release(now, child)
        now = grown
    tail = F.when(F.size("segments") > depth, F.lit("/**")).otherwise(F.lit(""))
    return now.withColumn("template", F.concat("template", tail)).drop("segments")


def _share(block: Column, labelled: Column, prior: Column) -> Column:
    return (block + F.lit(PRIOR) * prior) / (labelled + F.lit(PRIOR))


def shares(placed: DataFrame) -> DataFrame:
    """(host, template, share): the smoothed share of blocked among labelled pages."""
    sums = [F.sum(c).alias(c) for c in ("allow", "block")]
    leaf = placed.groupBy("host", "template").agg(*sums)
    host = leaf.groupBy("host").agg(F.sum("allow").alias("host_allow"), F.sum("block").alias("host_block"))
    # one row, so broadcasting it is bounded
    whole = host.agg(((F.coalesce(F.sum("host_block"), F.lit(0)) + 1) / (F.coalesce(F.sum("host_allow") + F.sum("host_block"), F.lit(0)) + 2)).alias("base"))
    of_host = host.join(F.broadcast(whole)).select("host", _share(F.col("host_block"), F.col("host_allow") + F.col("host_block"), F.col("base")).alias("prior"))
    return leaf.join(of_host, "host").select("host", "template", _share(F.col("block"), F.col("allow") + F.col("block"), F.col("prior")).alias("share"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", out: str = "__url") -> DataFrame:
    """pages with one column more: struct(host, path, rule, template, share, verdict)."""
    host, path = fresh(pages, "host", "path")
    parsed = pages.withColumn(host, host_of(pages[url_col])).withColumn(path, path_of(pages[url_col]))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    urls = parsed.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n")).withColumn("verdict", hit["verdict"])
    labelled = lambda v: F.when(F.col("verdict") == v, F.col("n")).otherwise(F.lit(0)).cast("long").alias(v)
    placed = templates(urls.select("host", "path", "n", labelled("allow"), labelled("block")))
    known = placed.join(shares(placed), ["host", "template"]).select(F.col("host").alias(host), F.col("path").alias(path), F.struct("template", "share").alias(out))
    rows = parsed.join(known, [host, path])
    mine = rule_of(F.col(host), F.col(path), rules)
    learned = F.when(F.col(out)["share"] >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(mine["verdict"], learned)
    result = F.struct(F.col(host).alias("host"), F.col(path).alias("path"), mine["rule"].alias("rule"), F.col(out)["template"].alias("template"), F.col(out)["share"].alias("share"), verdict.alias("verdict"))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns], result.alias(out))


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """The rows of pages that neither a rule nor their template rejects."""
    [mark] = fresh(pages, "url")
    return judged(pages, rules, url_col, mark).where(F.col(mark)["verdict"] == "allow").drop(mark)


def query(pages: DataFrame) -> DataFrame:
    """The digest of op12: page_id, host, path, rule, verdict, template."""
    return judged(pages.select("page_id", "url")).select("page_id", "__url.host", "__url.path", "__url.rule", "__url.verdict", "__url.template")


def _sql_rule(field: int, rules: Sequence[tuple[str, str, str]]) -> str:
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[field]}'" for v, h, p in longest) + " END"


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, depth: int = DEPTH) -> str:
    """The same result in SQL, over a relation pages with page_id and url."""
    steps = []
    for k in range(depth):
        steps.append(f"""
s{k} AS (SELECT *, segs[{k + 1}] AS seg FROM u{k}),
c{k} AS (SELECT host, t, seg, sum(n) n, sum(allow) allow, sum(block) block FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
n{k} AS (SELECT host, t, sum(n) nn, sum(allow) na, sum(block) nb FROM c{k} GROUP BY ALL),
x{k} AS (SELECT *, allow::DOUBLE a, block::DOUBLE b, (na - allow)::DOUBLE c, (nb - block)::DOUBLE d FROM c{k} JOIN n{k} USING (host, t) WHERE n >= {LEAST} AND n * {ONE_IN} >= nn),
k{k} AS (SELECT host, t, seg, true AS own FROM x{k} WHERE (a + b > 0 AND c + d = 0) OR ((a + b) * (c + d) * (a + c) * (b + d) > 0 AND (a * d - b * c) * (a * d - b * c) * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d)) >= {DIFFERS})),
u{k + 1} AS (SELECT host, path, n, allow, block, segs, t || CASE WHEN own THEN '/' || seg WHEN seg IS NOT NULL THEN '/*' ELSE '' END AS t FROM s{k} LEFT JOIN k{k} USING (host, t, seg))""")
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
r AS (SELECT *, {_sql_rule(0, rules)} AS rule, {_sql_rule(1, rules)} AS said FROM p),
u0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block, regexp_extract_all(path, '[^/]+') AS segs, '' AS t FROM r GROUP BY host, path),{",".join(steps)},
f AS (SELECT * REPLACE (t || CASE WHEN len(segs) > {depth} THEN '/**' ELSE '' END AS t) FROM u{depth}),
l AS (SELECT host, t, sum(allow) a, sum(block) b FROM f GROUP BY ALL),
h AS (SELECT host, sum(a) ha, sum(b) hb FROM l GROUP BY ALL),
g AS (SELECT (coalesce(sum(hb), 0) + 1)::DOUBLE / (coalesce(sum(ha + hb), 0) + 2)::DOUBLE AS base FROM h),
o AS (SELECT host, t, (b + {PRIOR}::DOUBLE * (hb + {PRIOR}::DOUBLE * base) / (ha + hb + {PRIOR}::DOUBLE)) / (a + b + {PRIOR}::DOUBLE) AS share FROM l JOIN h USING (host), g)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN share >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, t AS template
FROM r JOIN f USING (host, path) JOIN o USING (host, t)
"""


ORACLE = oracle()
