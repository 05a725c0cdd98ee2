"""URL filter: host and path rules first, then a path-template tree with labelled purity.

For every host a tree of path templates is grown level by level: a segment that is frequent below its node and has
no digit stays as it is, all others become ``*``. Sibling branches whose share of good labels does not differ from
the siblings' common share (a z-test) are merged: they pool their labels. Each node's purity is smoothed towards its
parent's, the host's towards the global share, and a URL is blocked if the purity of its template is too low.

Counts are aggregates with partial sums, so a host with most of the pages is no burden; the frequent segments of a
node are at most ``100 / SHARE`` many and are joined by a checked broadcast or a shuffle. Segments beyond the
deepest level form one last segment.

A null URL or one without ``://`` has an empty host and path and is judged as host ''. Rows are judged one by one,
so repeated rows stay; without any label everything that no rule blocks is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

from .components import sized
from .registry import query, table

LEVELS = 8
#: a segment is a branch of its own from so many URLs, and such a percentage of its node's, on
SUPPORT, SHARE = 3, 5
#: |z| up to which siblings are alike; weight of a parent's purity in labels; least purity allowed
ALIKE, WEIGHT, LEAST_PURITY = 1.64, 4.0, 0.5

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``nodes``: the templates of the path's levels, '' first."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    parts = F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.array_join(
        F.slice(parts, LEVELS, F.size(parts)), "/")))).otherwise(parts)
    rows = cut_lineage(urls.withColumn("parts", parts).withColumn("node", F.lit("")).withColumn("nodes", F.array(F.lit(""))))
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(deepest):
        here = rows.withColumn("segment", F.get("parts", F.lit(level)))
        children = here.where("segment is not null").groupBy("host", "node", "segment").agg(F.count("*").alias("n"))
        totals = children.groupBy("host", "node").agg(F.sum("n").alias("all_n"))
        frequent = children.where((F.col("n") >= SUPPORT) & ~F.col("segment").rlike("[0-9]")).join(totals, ["host", "node"]).where(
            F.col("n") * 100 >= F.col("all_n") * SHARE).select("host", "node", "segment", F.lit(True).alias("branch"))
        step = F.concat("node", F.lit("/"), F.when(F.col("branch"), F.col("segment")).otherwise("*"))
        has = F.col("segment").isNotNull()
        rows = cut_lineage(here.join(sized(frequent, "segment"), ["host", "node", "segment"], "left")
                           .withColumn("node", F.when(has, step).otherwise(F.col("node")))
                           .withColumn("nodes", F.when(has, F.concat("nodes", F.array("node"))).otherwise(F.col("nodes")))
                           .drop("segment", "branch"))
    return rows.drop("parts", "node")


def purities(rows: DataFrame) -> DataFrame:
    """``host, node, purity`` of every node of ``rows`` (host, nodes, good: 1, 0 or null)."""
    at = rows.groupBy("host", "nodes").agg(F.count("good").cast("long").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("g"))
    counts = cut_lineage(at.select("host", "n", "g", "nodes", F.posexplode("nodes").alias("level", "node")).select(
        "host", "level", "node", F.when(F.col("level") > 0, F.get("nodes", F.col("level") - 1)).alias("parent"), "n", "g")
        .groupBy("host", "level", "node", "parent").agg(F.sum("n").alias("n"), F.sum("g").alias("g")))
    total = counts.where("level = 0").agg(F.sum("n"), F.sum("g")).first()
    overall = total[1] / total[0] if total[0] else 1.0
    depth = counts.agg(F.max("level")).first()[0] or 0
    level = counts.where("level = 0").select("host", "node", ((F.col("g") + WEIGHT * F.lit(overall)) / (F.col("n") + WEIGHT)).alias("purity"))
    out = level
    for i in range(1, depth + 1):
        nodes = counts.where(F.col("level") == i)
        pool = nodes.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
        rate = F.col("pg") / F.when(F.col("pn") > 0, F.col("pn"))
        spread = F.col("n") * rate * (1 - rate)
        off = F.col("g") - F.col("n") * rate
        alike = F.coalesce(off * off <= ALIKE * ALIKE * spread, F.lit(True)) | F.coalesce(spread == 0, F.lit(True))
        nodes = nodes.join(pool, ["host", "parent"]).withColumn("alike", alike)
        merged = nodes.groupBy("host", "parent", "alike").agg(F.sum("n").alias("mn"), F.sum("g").alias("mg"))
        above = level.select("host", F.col("node").alias("parent"), F.col("purity").alias("above"))
        n, g = (F.when(F.col("alike"), F.col(f"m{c}")).otherwise(F.col(c)) for c in "ng")
        level = cut_lineage(nodes.join(merged, ["host", "parent", "alike"]).join(above, ["host", "parent"]).select(
            "host", "node", ((g + WEIGHT * F.col("above")) / (n + WEIGHT)).alias("purity")))
        out = out.union(level)
    return out


def judge(urls: DataFrame, rules=RULES, least_purity: float = LEAST_PURITY) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of rows ``page_id, url, good``; ``good`` is 1, 0 or,
    without a label, null."""
    host, path = host_and_path(F.col("url"))
    rows = templates(urls.select("page_id", host.alias("host"), path.alias("path"), "good"))
    purity = purities(rows)
    rows = rows.withColumn("node", F.element_at("nodes", -1)).join(sized(purity, "node"), ["host", "node"], "left")
    found = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("purity") >= least_purity, "allow").otherwise("block")).alias("verdict"),
        F.col("node").alias("template"), F.round("purity", 9).alias("purity"))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the label of the document that the first number in the URL's path names."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(host_and_path(F.col("url"))[1], "([0-9]+)", 1)
    pages = pages.withColumn("doc_id", number.try_cast("bigint"))
    return pages.join(labels, "doc_id", "left").select("page_id", "url", "good")


def _sql() -> str:
    levels = [f"""
t0 as (select *, '' as node, [''] as nodes from parts)"""]
    for i in range(LEVELS):
        levels.append(f"""
c{i} as (select host, node, segs[{i + 1}] as seg, count(*) as n from t{i} where len(segs) > {i} group by all),
f{i} as (select host, node, seg from (select *, sum(n) over (partition by host, node) as all_n from c{i})
  where n >= {SUPPORT} and n * 100 >= all_n * {SHARE} and not regexp_matches(seg, '[0-9]')),
u{i} as (select t.* exclude (node, nodes), t.nodes, case when len(segs) > {i} then t.node || '/' || coalesce(f.seg, '*') else t.node end as node
  from t{i} t left join f{i} f on f.host = t.host and f.node = t.node and f.seg = t.segs[{i + 1}]),
t{i + 1} as (select * exclude (nodes), case when len(segs) > {i} then list_append(nodes, node) else nodes end as nodes from u{i})""")
    purity = [f"""
counts as (select host, level, nodes[level + 1] as node, case when level > 0 then nodes[level] end as parent, count(good) as n,
  coalesce(sum(good), 0) as g from (select *, unnest(range(len(nodes))) as level from t{LEVELS}) group by all),
overall as (select coalesce(sum(g) / nullif(sum(n), 0), 1.0) as p from counts where level = 0),
p0 as (select host, node, (g + {WEIGHT} * p) / (n + {WEIGHT}) as purity from counts, overall where level = 0)"""]
    for i in range(1, LEVELS + 1):
        purity.append(f"""
a{i} as (select *, coalesce(power(g - n * rate, 2) <= {ALIKE * ALIKE} * n * rate * (1 - rate), true)
    or coalesce(n * rate * (1 - rate) = 0, true) as alike
  from (select *, sum(g) over (partition by host, parent) / nullif(sum(n) over (partition by host, parent), 0) as rate
    from counts where level = {i})),
m{i} as (select *, sum(n) over (partition by host, parent, alike) as mn, sum(g) over (partition by host, parent, alike) as mg from a{i}),
p{i} as (select m.host, m.node, (case when alike then mg else g end + {WEIGHT} * p.purity) / (case when alike then mn else n end + {WEIGHT})
  as purity from m{i} m join p{i - 1} p on p.host = m.host and p.node = m.parent)""")
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        whens.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + start}')", rule, verdict))
    rule = "case " + " ".join(f"when {w} then '{r}'" for w, r, _ in whens) + " end"
    verdict = "case " + " ".join(f"when {w} then '{v}'" for w, _, v in whens)
    union = " union all ".join(f"select * from p{i}" for i in range(LEVELS + 1))
    return f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
urls as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
known as (select doc_id, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels where doc_id is not null group by doc_id),
named as (select u.*, k.good from urls u left join known k on k.doc_id = try_cast(regexp_extract(u.path, '([0-9]+)', 1) as bigint)),
raw as (select *, list_filter(string_split(path, '/'), lambda s: s <> '') as s from named),
parts as (select * exclude (s), case when len(s) > {LEVELS} then list_append(s[1:{LEVELS - 1}], array_to_string(s[{LEVELS}:], '/')) else s end as segs
  from raw),{",".join(levels)},{",".join(purity)},
every as ({union})
select page_id, t.host, path, {rule.replace("(host", "(t.host").replace("with(host", "with(t.host")} as rule,
  {verdict.replace("(host", "(t.host").replace("with(host", "with(t.host")} else case when e.purity >= {LEAST_PURITY} then 'allow' else 'block' end end as verdict,
  t.node as template, round(e.purity, 9) as purity
from t{LEVELS} t left join every e on e.host = t.host and e.node = t.node
"""


@query("op3_path_template_url_filter", _sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(labelled_pages(spark, sf_dir))
