"""URL filters: site rules first, then a path-template tree learned per host, in DataFrame operations alone.

*Templates.* A path is cut into segments. A segment is variable, and becomes a wildcard, if its value is rare at its depth on its
host (fewer than ``COMMON`` of the pages there, and fewer than ``COMMON_PAGES`` pages) or has a digit; its kind (number, word, mixed)
stays in the wildcard. What is left, a host and a list of constants and wildcards, is a branch of the tree.

*Merging.* Branches of one host that differ in constants only are statistically alike if their labelled purity differs from
that of the branches' union by at most ``ALIKE`` standard errors. Alike branches are judged by their union's counts, others by their own.
A branch without labels of its own is alike to nothing.

*Purity.* Labels are the verdicts of the rules on the pages that rules cover. A branch's purity is its share of blocked labelled
pages, smoothed by ``PRIOR_PAGES`` pages of the share in all labelled pages. Purity of ``REJECT`` or more blocks a template.

Counts of hosts, segments and branches are pre-aggregated sums, so a host may hold any share of the pages.

Defined cases: a null url, or one without ://, has an empty host and path, like a url with nothing after ://; these make one branch
without rules. An empty table gives an empty one. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

#: host/path and verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
COMMON, COMMON_PAGES = 0.01, 20
ALIKE = 2.0
PRIOR_PAGES = 5.0
REJECT = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    after = rest.substr(F.length(host) + F.lit(1), F.length(rest))
    return pages.withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", F.regexp_extract(after, "^([^?#]*)", 1))


def _fits(host: str, path: str) -> Column:
    own = (F.col("host") == host) | F.col("host").endswith("." + host)
    return own & F.col("path").startswith(path)


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (host, path) with ``rule``, the longest that fits (then the first in code point order), and ``ruled``, its verdict."""
    name = verdict = None
    for host, path, said in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = _fits(host, path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return pages.withColumn("rule", F.lit(None).cast("string") if name is None else name).withColumn("ruled", F.lit(None).cast("string") if verdict is None else verdict)


def _wildcard(segment: Column) -> Column:
    return F.when(segment.rlike("^[0-9]+$"), "*number").when(segment.rlike("[0-9]"), "*mixed").otherwise("*word")


def templates(parted: DataFrame) -> DataFrame:
    """(host, path, template, shape) for every distinct path: its branch, and the branch with all constants open.

    Paths are counted once, their segments then stand one to a row, so common values are plain grouped sums.
    """
    paths = stored(parted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")), "paths")
    segments = paths.select("host", "path", "pages", F.posexplode(F.split("path", "/")).alias("depth", "segment"))
    common = segments.groupBy("host", "depth", "segment").agg(F.sum("pages").alias("here"))
    depth = segments.groupBy("host", "depth").agg(F.sum("pages").alias("there"))
    constant = common.where(~F.col("segment").rlike("[0-9]")).join(depth, ["host", "depth"]).where((F.col("here") >= COMMON_PAGES) | (F.col("here") >= COMMON * F.col("there")))
    constant = constant.select("host", "depth", "segment", F.lit(True).alias("constant"))
    named = segments.join(constant, ["host", "depth", "segment"], "left")
    kept = F.coalesce("constant", F.lit(False)) | (F.col("segment") == "")
    named = named.select("host", "path", "depth", F.when(kept, F.col("segment")).otherwise(_wildcard(F.col("segment"))).alias("name"), F.when(F.col("segment") == "", "").when(kept, "*").otherwise(_wildcard(F.col("segment"))).alias("open"))
    rows = F.array_sort(F.collect_list(F.struct("depth", "name", "open")))  # one entry per segment of one path
    return named.groupBy("host", "path").agg(rows.alias("s")).select("host", "path", F.array_join("s.name", "/").alias("template"), F.array_join("s.open", "/").alias("shape"))


def purity(ruled: DataFrame, branches: DataFrame) -> DataFrame:
    """(host, template, purity): smoothed share of blocked pages of every branch, its own or its union's."""
    labels = ruled.where("ruled is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("bad"))
    own = branches.join(labels, ["host", "path"], "left").groupBy("host", "shape", "template").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    union = own.groupBy("host", "shape").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    total = own.agg((F.sum("bad").cast("double") / F.greatest(F.sum("n"), F.lit(1))).alias("prior")).first()
    prior = float(total.prior or 0.0)
    rows = own.join(union, ["host", "shape"])
    share = F.col("all_bad") / F.greatest(F.col("all_n"), F.lit(1))
    error = F.sqrt(share * (1 - share) / F.greatest(F.col("n"), F.lit(1)))
    alike = (F.col("n") > 0) & (F.abs(F.col("bad") / F.greatest(F.col("n"), F.lit(1)) - share) <= ALIKE * error)
    n, bad = F.when(alike, F.col("all_n")).otherwise(F.col("n")), F.when(alike, F.col("all_bad")).otherwise(F.col("bad"))
    return rows.select("host", "template", ((bad + PRIOR_PAGES * F.lit(prior)) / (n + PRIOR_PAGES)).alias("purity"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Row per page: page_id, host, path, rule, verdict, template and its purity."""
    parted = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "url").select("page_id", "host", "path")
    ruled = with_rule(stored(parted, "urls"))
    branches = stored(templates(ruled), "branches")
    chances = purity(ruled, branches)
    paths = branches.join(chances, ["host", "template"]).select("host", "path", "template", "purity")
    out = ruled.join(paths, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")


_SQL_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}:{v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])))
_SQL_WILD = "CASE WHEN regexp_matches(segment, '^[0-9]+$') THEN '*number' WHEN regexp_matches(segment, '[0-9]') THEN '*mixed' ELSE '*word' END"

SQL = f"""WITH parts AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM parts),
urls AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM hosts),
ruled AS (SELECT page_id, host, path, string_split(r, ':')[1] AS rule, string_split(r, ':')[2] AS ruled FROM (SELECT *, CASE {_SQL_RULES} END AS r FROM urls)),
paths AS (SELECT host, path, count(*) AS pages FROM ruled GROUP BY ALL),
segments AS (SELECT host, path, pages, unnest(string_split(path, '/')) AS segment, generate_subscripts(string_split(path, '/'), 1) AS depth FROM paths),
common AS (SELECT host, depth, segment, sum(pages) AS here FROM segments GROUP BY ALL),
depths AS (SELECT host, depth, sum(pages) AS there FROM segments GROUP BY ALL),
constants AS (SELECT host, depth, segment, true AS constant FROM common JOIN depths USING (host, depth) WHERE NOT regexp_matches(segment, '[0-9]') AND (here >= {COMMON_PAGES} OR here >= {COMMON} * there)),
named AS (SELECT host, path, depth, CASE WHEN coalesce(constant, false) OR segment = '' THEN segment ELSE {_SQL_WILD} END AS name,
  CASE WHEN segment = '' THEN '' WHEN coalesce(constant, false) THEN '*' ELSE {_SQL_WILD} END AS open FROM segments LEFT JOIN constants USING (host, depth, segment)),
branches AS (SELECT host, path, string_agg(name, '/' ORDER BY depth) AS template, string_agg(open, '/' ORDER BY depth) AS shape FROM named GROUP BY host, path),
labels AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL),
own AS (SELECT host, shape, template, sum(coalesce(n, 0)) AS n, sum(coalesce(bad, 0)) AS bad FROM branches LEFT JOIN labels USING (host, path) GROUP BY ALL),
unions AS (SELECT host, shape, sum(n) AS all_n, sum(bad) AS all_bad FROM own GROUP BY ALL),
total AS (SELECT coalesce(sum(bad)::DOUBLE / greatest(sum(n), 1), 0) AS prior FROM own),
shares AS (SELECT *, all_bad::DOUBLE / greatest(all_n, 1) AS share FROM own JOIN unions USING (host, shape) CROSS JOIN total),
tested AS (SELECT *, n > 0 AND abs(bad::DOUBLE / greatest(n, 1) - share) <= {ALIKE} * sqrt(share * (1 - share) / greatest(n, 1)) AS alike FROM shares),
chances AS (SELECT host, template, (CASE WHEN alike THEN all_bad ELSE bad END + {PRIOR_PAGES}::DOUBLE * prior) / (CASE WHEN alike THEN all_n ELSE n END + {PRIOR_PAGES}::DOUBLE) AS purity FROM tested)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM ruled JOIN branches USING (host, path) JOIN chances USING (host, template)"""
