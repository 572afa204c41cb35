"""URL verdicts by rules and by a path-template tree.

A path is cut into segments; beyond `DEPTH` the rest is one segment. Runs of digits and long hexadecimal
names are generalised at once. Then, level by level below each host, a node whose children are mostly
singles gets the wildcard `*` for all of them, and children whose labelled bad share doesn't differ from
their siblings' (a two-proportion test at `SIMILAR`) are merged into the branch `~`. A template is
rejected if its labelled bad share, smoothed by `SMOOTH` rows of the overall share, reaches `REJECT`.
A rule that fits a page goes before its template.

DataFrame functions only. All pages of a host and generalised path are one row before the tree is built,
so a hot host costs the tree no more than its distinct paths.
"""
from pyspark.sql import functions as F

from panelcast.sources.files import store

DEPTH, SIMILAR, SMOOTH, REJECT, MANY = 3, 3.84, 10.0, 0.5, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host and path, verdict) of the registered query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def parts(url="url"):
    """Host and path columns of a URL; both empty without `://`."""
    url = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    name = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(name) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(name, UPPER, LOWER).alias("host"), path.alias("path")


def longest_rule(rules):
    """Struct (size, host size, rule, verdict) of the longest rule that fits columns host and path, or null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,own:int,rule:string,verdict:string>")
    table = []
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        table.append(F.struct(F.lit(len(rule)).alias("size"), F.lit(len(host)).alias("own"), F.lit(rule).alias("rule"),
                              F.lit(verdict).alias("verdict"), F.lit(host).alias("host"), F.lit(slash + path).alias("path")))
    fits = F.filter(F.array(*table), lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"])))
                    & F.startswith(F.col("path"), r["path"]))
    return F.array_max(fits)


def generalised(path="path"):
    """Segments 1..DEPTH of a path, the last with all that follows; digits and hexadecimal names as wildcards."""
    names = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(names, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{12,}$"), "{hex}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    out = [F.coalesce(F.get(plain, F.lit(k)), F.lit("")) for k in range(DEPTH - 1)]
    rest = F.array_join(F.when(F.size(plain) >= DEPTH, F.slice(plain, DEPTH, F.greatest(F.size(plain), F.lit(1)))).otherwise(F.array()), "/")
    return [c.alias(f"s{k + 1}") for k, c in enumerate([*out, rest])]


def templates(paths):
    """`paths` (host, s1.., n, labelled, bad) with the template of each: its segments or `*` or `~`, joined by /."""
    paths = paths.withColumn("template", F.lit(""))
    for k in range(1, DEPTH + 1):
        node, child = ["host", "template"], ["host", "template", f"s{k}"]
        children = paths.groupBy(*child).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        nodes = children.groupBy(*node).agg(F.count("*").alias("children"), F.sum((F.col("n") == 1).cast("int")).alias("singles"),
                                            F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        share = F.col("all_bad") / F.col("all_labelled")
        rest = F.col("all_labelled") - F.col("labelled")
        gap = F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / rest
        spread = share * (1 - share) * (1 / F.col("labelled") + 1 / rest)
        alike = (F.col("labelled") == 0) | (rest == 0) | (F.col("all_bad") == 0) | (F.col("all_bad") == F.col("all_labelled"))
        alike = F.when(alike, True).otherwise(gap * gap < F.lit(SIMILAR) * spread)
        name = (F.when(F.col("children") == 1, F.col(f"s{k}"))
                .when((F.col("children") >= MANY) & (F.col("singles") * 2 >= F.col("children")), "*")
                .when(alike, "~").otherwise(F.col(f"s{k}")))
        named = children.join(nodes, node).select(*child, F.concat("template", F.lit("/"), name).alias("longer"))
        paths = paths.join(named, child).withColumn("template", F.col("longer")).drop("longer")
        paths = store(paths, "templates")
    return paths


def judge(pages, labels, rules=RULES, page_id="page_id", url="url"):
    """One row per row of `pages`: page_id, host, path, rule, verdict, template.

    `labels` has page_id and bad (0 or 1); rows with nulls in either are left out, a page with several counts
    with its worst. A null URL, or one without `://`, has an empty host and path and a template of its own
    like any other. Repeated pages are judged each.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), *parts(url))
    rows = rows.select("*", *generalised())
    known = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(
        F.max(F.col("bad").cast("long")).alias("bad"))
    keys = ["host", *[f"s{k}" for k in range(1, DEPTH + 1)]]
    paths = rows.join(known, "page_id", "left").groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = store(templates(store(paths, "paths")), "templates")
    total = paths.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()
    prior = (total.b or 0) / total.n if total.n else 0.0
    sums = paths.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    sums = sums.withColumn("purity", (F.col("all_bad") + SMOOTH * prior) / (F.col("all_labelled") + SMOOTH))
    judged = paths.join(sums, ["host", "template"]).select(*keys, "template", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("own"))
    rule = longest_rule(rules)
    out = rows.join(judged, keys).withColumn("_rule", rule)
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "own").alias("verdict"), "template")


def oracle():
    """The registered query in SQL."""
    digits = "list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{12,}$') THEN '{hex}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END)"
    segments = ", ".join(f"coalesce(g[{k}], '') AS s{k}" for k in range(1, DEPTH))
    keys = ", ".join(["host", *[f"s{k}" for k in range(1, DEPTH + 1)]])
    levels = ["t0 AS (SELECT *, '' AS template FROM paths)"]
    for k in range(1, DEPTH + 1):
        levels.append(f"""c{k} AS (SELECT host, template, s{k}, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM t{k - 1} GROUP BY ALL),
n{k} AS (SELECT host, template, count(*) AS children, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS singles, sum(labelled) AS al, sum(bad) AS ab FROM c{k} GROUP BY ALL),
m{k} AS (SELECT c.host, c.template, s{k}, c.template || '/' || CASE WHEN children = 1 THEN s{k} WHEN children >= {MANY} AND singles * 2 >= children THEN '*'
  WHEN CASE WHEN labelled = 0 OR al = labelled OR ab = 0 OR ab = al THEN true ELSE
    (bad::DOUBLE / labelled - (ab - bad)::DOUBLE / (al - labelled)) * (bad::DOUBLE / labelled - (ab - bad)::DOUBLE / (al - labelled))
    < {SIMILAR} * ((ab::DOUBLE / al) * (1 - ab::DOUBLE / al) * (1.0::DOUBLE / labelled + 1.0::DOUBLE / (al - labelled))) END THEN '~' ELSE s{k} END AS longer
  FROM c{k} c JOIN n{k} USING (host, template)),
t{k} AS (SELECT t{k - 1}.* REPLACE (longer AS template) FROM t{k - 1} JOIN m{k} USING (host, template, s{k}))""")
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
    levels = ",\n".join(levels)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS a FROM u),
p AS (SELECT page_id, translate(a, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(a) + 1), '^[^?#]*') AS path FROM h),
g AS (SELECT *, {digits} AS g FROM p),
rows AS (SELECT page_id, host, path, {segments}, array_to_string(g[{DEPTH}:], '/') AS s{DEPTH} FROM g),
known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
paths AS (SELECT {keys}, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM rows LEFT JOIN known USING (page_id) GROUP BY ALL),
{levels},
prior AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0) AS prior FROM t{DEPTH}),
sums AS (SELECT host, template, (sum(bad) + {SMOOTH} * any_value(prior)) / (sum(labelled) + {SMOOTH}) AS purity FROM t{DEPTH}, prior GROUP BY host, template),
judged AS (SELECT {keys}, template, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END AS own FROM t{DEPTH} JOIN sums USING (host, template)),
rules(rule, rh, rp, rv) AS (VALUES {rules}),
hit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv FROM p JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rv, own) AS verdict, template FROM rows JOIN judged USING ({keys}) LEFT JOIN hit USING (page_id)"""
