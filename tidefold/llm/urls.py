"""URL filter: host and path rules, then a path-template tree per host.

The tree is built from the root as grouped counts, one round for each branching
along a path: what all urls below a node have in common is taken over at once,
so rounds follow the branchings and not the length of paths. Digits, long hex
strings and UUIDs become placeholders first. Below a node, a segment keeps its
own branch while it holds one in SHARE of the node's urls; all others become the
wildcard ``*``, so a node has at most ``SHARE`` branches however many urls a host
has. Templates that differ in one segment and whose labelled block rates are
statistically alike are merged.

A template is rejected when its smoothed share of blocked labels is high. The
rate of the host is smoothed towards that of all labelled pages, that of every
node towards its parent's, and that of a template towards its last ancestor's,
so branches without labels are judged by what is known above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

Rule = tuple[str, str, str]

#: Fixed values of the registered query: verdict, host, path.
RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
SHARE, MIN_LABELS, ALPHA, REJECT_AT, Z = 100, 5, 2.0, 0.9, 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; ties go to the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    """Segments with their variable parts as placeholders."""
    p = F.regexp_replace(path, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "{u}")
    p = F.regexp_replace(p, r"\b[0-9a-f]{16,}\b", "{x}")
    return F.split(F.regexp_replace(p, r"[0-9]+", "{n}"), "/")


def _joined(template: Column | str, segs: Column) -> Column:
    return F.concat(template, F.concat_ws("", F.transform(segs, lambda s: F.concat(F.lit("/"), s))))


def _templates(paths: DataFrame) -> DataFrame:
    """(host, segs) -> template, by keeping frequent segments from the root on.

    ``paths`` has host, segs, n, bad, labelled: one row for each distinct shape of a path.
    """
    cur = cut_lineage(paths.select("host", "segs", "n", "bad", "labelled", F.lit("").alias("template"), F.col("segs").alias("rest")))
    kept = [c for c in cur.columns if c not in ("template", "rest")]
    while not cur.where(F.size("rest") > 0).isEmpty():
        open_ = cur.where(F.size("rest") > 0)
        # What the least and the greatest path below a node share, all share.
        node = open_.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        differ = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        common = F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int")
        node = node.select("host", "template", common.alias("common"))
        deeper = open_.join(node, ["host", "template"]).select(
            *kept,
            _joined("template", F.slice("rest", F.lit(1), F.col("common"))).alias("template"),
            F.slice("rest", F.col("common") + 1, F.greatest(F.size("rest"), F.lit(1))).alias("rest"),
        ).withColumn("seg", F.get("rest", F.lit(0)))
        child = deeper.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("c"))
        total = child.groupBy("host", "template").agg(F.sum("c").alias("all"))
        own = child.join(total, ["host", "template"]).where(F.col("c") * SHARE >= F.col("all")).select("host", "template", "seg", F.lit(True).alias("own"))
        grown = deeper.join(own, ["host", "template", "seg"], "left").select(
            *kept,
            F.when(F.col("seg").isNull(), F.col("template"))
            .otherwise(F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(F.lit("*"))))
            .alias("template"),
            F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"),
        )
        cur = cut_lineage(cur.where(F.size("rest") == 0).select(*grown.columns).union(grown))
    return cur.drop("rest")


def _merged(templates: DataFrame) -> DataFrame:
    """host, template, merged, bad, labelled: each template with the name of its pool.

    Templates that differ in one segment only are pooled there; each whose block
    rate is within Z standard errors of that of the others may join the pool, and
    joins that of its last such segment. Templates of fewer than MIN_LABELS labels stay
    by themselves.
    """
    cur = cut_lineage(templates.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("k")))
    segs = F.split("template", "/")
    at = F.explode(F.filter(F.sequence(F.lit(2), F.greatest(F.size(segs), F.lit(3)) - 1), lambda d: d < F.size(segs)))
    each = cur.where(F.col("k") >= MIN_LABELS).select("*", at.alias("d"))
    hidden = F.transform(segs, lambda s, i: F.when(i == F.col("d"), F.lit("*")).otherwise(s))
    each = each.select("host", "template", "b", "k", "d", F.array_join(hidden, "/").alias("pool"))
    pooled = each.groupBy("host", "pool").agg(F.sum("b").alias("pb"), F.sum("k").alias("pk"), F.count("*").alias("branches"))
    rate, others = F.col("pb") / F.col("pk"), F.col("pk") - F.col("k")
    apart = F.abs(F.col("b") * others - (F.col("pb") - F.col("b")) * F.col("k"))
    alike = apart <= Z * F.sqrt(rate * (1 - rate) * F.col("pk") * F.col("k") * others)
    joins = each.join(pooled.where("branches > 1"), ["host", "pool"]).where(alike)
    joins = joins.groupBy("host", "template").agg(F.max_by("pool", "d").alias("pool"))
    return cur.join(joins, ["host", "template"], "left").select(
        "host", "template", F.coalesce("pool", "template").alias("merged"), F.col("b").alias("bad"), F.col("k").alias("labelled")
    )


def _purity(merged: DataFrame) -> DataFrame:
    """host, template, merged, n_labels, purity."""
    known = merged.where("labelled > 0")
    seen = known.agg(F.sum("bad"), F.sum("labelled")).first()
    overall = ((seen[0] or 0) + 1) / ((seen[1] or 0) + 2)
    segs = F.split("template", "/")
    upto = F.filter(F.sequence(F.lit(2), F.greatest(F.size(segs), F.lit(2))), lambda d: d < F.size(segs))
    above = lambda df: df.select("*", F.explode(upto).alias("d")).withColumn("node", F.array_join(F.slice(segs, F.lit(1), F.col("d")), "/"))
    nodes = above(known).groupBy("host", "node").agg(F.sum("bad").alias("nb"), F.sum("labelled").alias("nk"))
    chain = (
        above(merged.select("host", "template"))
        .join(nodes, ["host", "node"])
        .groupBy("host", "template")
        .agg(F.array_sort(F.collect_list(F.struct("d", "nb", "nk"))).alias("chain"))
    )
    prior = F.coalesce(
        F.aggregate("chain", F.lit(overall).cast("double"), lambda p, x: (x["nb"] + ALPHA * p) / (x["nk"] + ALPHA)), F.lit(overall)
    )
    pools = merged.groupBy("host", "merged").agg(F.sum("bad").alias("pb"), F.sum("labelled").alias("n_labels"))
    return (
        merged.join(pools, ["host", "merged"])
        .join(chain, ["host", "template"], "left")
        .select("host", "template", "merged", "n_labels", ((F.col("pb") + ALPHA * prior) / (F.col("n_labels") + ALPHA)).alias("purity"))
    )


def filter_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_labels, purity for every row.

    ``labels`` (page_id, bad 0/1) are the labelled pages; without it, the pages
    that a rule judges are the labelled ones, a block counting as bad. Purity is
    ``(bad + ALPHA * p) / (labelled + ALPHA)`` with p the same of the parent, and
    for hosts ``(bad + 1) / (labelled + 2)`` of all labelled pages; a template is
    rejected from REJECT_AT. Of rules that fit and are as long, the first listed
    counts. Null urls have an empty host and path and are judged like any other
    template. Urls of any length and depth are judged whole. Repeated rows give
    repeated results, an empty table none; other columns, whatever their names,
    are left out.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), _shape(F.col("path")).alias("segs"))
    if labels is None:
        labelled = base.withColumn("bad", (F.col("by_rule") == "block").cast("long"))
    else:
        known = labels.groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
        labelled = base.join(known, "page_id", "left")
    paths = labelled.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("labelled")
    )
    templates = _templates(paths)
    judged = templates.select("host", "segs", "template").join(_purity(cut_lineage(_merged(templates))), ["host", "template"])
    judged = cut_lineage(judged.select("host", "segs", F.col("merged").alias("template"), "n_labels", "purity"))
    by_method = F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow")
    return base.join(judged, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "n_labels", "purity"
    )


def oracle(rules: list[Rule] = RULES) -> str:
    """The registered query as DuckDB SQL: the tree a level at a time, over recursive tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(a, h, p)}'" for a, h, p in order) + " END"
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    share = "sum(n) OVER (PARTITION BY host, template, segs[d + 1])"
    shown = "string_split(template, '/')"
    above = "array_to_string(string_split({t}, '/')[1:{d}], '/')".format
    return rf"""
WITH RECURSIVE p0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p0),
p2 AS (SELECT page_id, translate(raw, '{upper}', '{upper.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p1),
base AS (SELECT *, {pick(lambda a, h, p: h + p)} AS rule, {pick(lambda a, h, p: a)} AS by_rule,
  string_split(regexp_replace(regexp_replace(regexp_replace(path, '\b{uuid}\b', '{{u}}', 'gi'), '\b[0-9a-f]{{16,}}\b', '{{x}}', 'g'),
    '[0-9]+', '{{n}}', 'g'), '/') AS segs FROM p2),
shapes AS (SELECT host, segs, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (by_rule = 'block') AS bad, count(by_rule) AS labelled FROM base GROUP BY host, segs),
walk AS (SELECT host, segs, n, bad, labelled, '' AS template, 0 AS d FROM shapes
  UNION ALL SELECT host, segs, n, bad, labelled, template || '/' ||
    CASE WHEN {share} * {SHARE} >= sum(n) OVER (PARTITION BY host, template) THEN segs[d + 1] ELSE '*' END, d + 1
  FROM walk WHERE d < len(segs)),
leaf AS (SELECT * FROM walk WHERE d = len(segs)),
t AS (SELECT host, template, CAST(sum(bad) AS DOUBLE) AS b, CAST(sum(labelled) AS DOUBLE) AS k FROM leaf GROUP BY host, template),
place AS (SELECT *, unnest(range(2, len({shown}))) AS d FROM t WHERE k >= {MIN_LABELS}),
pool AS (SELECT *, array_to_string({shown}[1:d] || ['*'] || {shown}[d + 2:], '/') AS pool FROM place),
rate AS (SELECT host, pool, sum(b) AS pb, sum(k) AS pk, sum(b) / sum(k) AS r FROM pool GROUP BY host, pool HAVING count(*) > 1),
joined AS (SELECT host, template, max_by(pool, d) AS pool FROM pool JOIN rate USING (host, pool)
  WHERE abs(b * (pk - k) - (pb - b) * k) <= {Z}::DOUBLE * sqrt(r * (1 - r) * pk * k * (pk - k)) GROUP BY host, template),
m AS (SELECT host, template, b, k, coalesce(pool, template) AS merged FROM t LEFT JOIN joined USING (host, template)),
nodes AS (SELECT host, {above(t="template", d="d")} AS node, sum(b) AS b, sum(k) AS k
  FROM (SELECT *, unnest(range(2, len({shown}))) AS d FROM t WHERE k > 0) GROUP BY ALL),
down AS (SELECT host, template, 2 AS d, (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(k), 0) + 2) FROM t) AS p FROM t
  UNION ALL SELECT w.host, w.template, w.d + 1, CASE WHEN x.k IS NULL THEN w.p ELSE (x.b + {ALPHA}::DOUBLE * w.p) / (x.k + {ALPHA}::DOUBLE) END
  FROM down w LEFT JOIN nodes x ON x.host = w.host AND x.node = {above(t="w.template", d="w.d")}
  WHERE w.d < len(string_split(w.template, '/'))),
q AS (SELECT host, merged, sum(b) AS b, sum(k) AS k FROM m GROUP BY host, merged),
judged AS (SELECT m.host, m.template, m.merged, CAST(q.k AS BIGINT) AS n_labels, (q.b + {ALPHA}::DOUBLE * w.p) / (q.k + {ALPHA}::DOUBLE) AS purity
  FROM m JOIN q ON q.host = m.host AND q.merged = m.merged
  JOIN down w ON w.host = m.host AND w.template = m.template AND w.d = len(string_split(m.template, '/')))
SELECT page_id, base.host AS host, path, rule, coalesce(by_rule, CASE WHEN purity >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict,
  merged AS template, n_labels, purity
FROM base JOIN leaf ON leaf.host = base.host AND leaf.segs = base.segs
JOIN judged ON judged.host = leaf.host AND judged.template = leaf.template"""
