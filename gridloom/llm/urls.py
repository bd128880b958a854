"""URL verdicts from a path-template tree per host, in DataFrame functions only.

Paths are cut into segments. Level by level, from the root of each host:

* a segment that is a number, or a number before an extension, is generalised to `<n>` at once;
* a node's children that have `least` labels are sorted by their share of bad pages, and those with fewer labels are
  pooled as one; from the cleanest on, each is merged with the branch before it unless a two-proportion z score tells
  their shares apart (|z| >= `z`). So children that are alike share a branch, wherever their shares lie, and children
  that differ do not, however many siblings they have;
* a branch of one child keeps its name; the branch with the pooled children, or that of all, is `*`; others are `*1`,
  `*2`, ... from the cleanest on.

Shares are rounded down to 1/64 for this, so a node has 65 groups of children at most, whatever its size.

After `depth` levels the tree goes on for as long as a node has labels enough to split, to any depth; what follows
the last node with several branches becomes one `**`. `sql` stops at `depth`, so it agrees where no path is longer.
Each template's labelled purity is the share of good pages,
smoothed by its host's share (itself smoothed by the overall one); a template whose purity is under `purity`
is rejected. All pages are first counted by host and segments, so everything after works on distinct paths.

Rules, if any, go first: a rule is a host, with all its subdomains, and a path prefix; the longest rule that
fits decides. A null url, or one without ://, has an empty host and path and is allowed. Ties and repeated
rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to ? or #; both empty where the url has no ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as its string host + path, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def typed(segment: Column) -> Column:
    """A number, alone or before an extension, as <n>."""
    return F.regexp_replace(segment, r"^[0-9]+(\.[A-Za-z0-9]+)?$", "<n>$1")


BINS = 64


def _children(rows: DataFrame, z: float, least: int) -> DataFrame:
    """(host, template, seg) of the children of each node, with name, kinds, splits (the node has several branches) and may_split (labels enough)."""
    node = ["host", "template"]
    child = rows.where("seg is not null").groupBy(*node, "seg").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    known = F.col("g") + F.col("b") >= least
    # children with few labels are one item, -1 for now; the others go by their share of bad pages
    child = child.withColumn("bin", F.when(known, F.floor(BINS * F.col("b") / (F.col("g") + F.col("b")))).otherwise(-1).cast("int"))
    item = child.groupBy(*node, "bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.count("*").alias("kinds"))
    rest, n = F.col("bin") == -1, F.col("g") + F.col("b")
    order = F.when(rest & (n > 0), BINS * F.col("b") / n).otherwise(F.col("bin")).cast("double")
    # pooled children without labels enough join the cleanest branch
    one = F.struct(order.alias("at"), "bin", "kinds", "g", "b", (rest & (n < least)).alias("few"))
    nodes = item.groupBy(*node).agg(F.array_sort(F.collect_list(one)).alias("items"), F.sum("kinds").alias("all"), F.sum("g").alias("pg"), F.sum("b").alias("pb"))  # 66 items at most

    def step(a: Column, x: Column) -> Column:
        n1, n2 = a["g"] + a["b"], x["g"] + x["b"]
        share = (a["b"] + x["b"]) / (n1 + n2)
        far = F.pow(a["b"] / n1 - x["b"] / n2, F.lit(2)) >= z * z * share * (1 - share) * (1 / n1 + 1 / n2)
        apart = F.coalesce((n1 >= least) & (n2 >= least) & ~x["few"] & (share > 0) & (share < 1) & far, F.lit(False))
        k = a["k"] + apart.cast("int")
        return F.struct(F.when(apart, x["g"]).otherwise(a["g"] + x["g"]).alias("g"), F.when(apart, x["b"]).otherwise(a["b"] + x["b"]).alias("b"), k.alias("k"), F.concat(a["ks"], F.array(k)).alias("ks"))

    zero = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("ks"))
    nodes = nodes.withColumn("ks", F.aggregate("items", zero, step)["ks"])
    branch = F.transform("items", lambda x, i: F.struct(x["bin"].alias("bin"), x["kinds"].alias("kinds"), F.get("ks", i).alias("k")))
    nodes = nodes.select(*node, "all", "pg", "pb", branch.alias("branch"))
    many = F.array_max("branch.k") > 0
    may_split = (F.col("pb") > 0) & (F.col("pg") > 0) & (F.col("pg") + F.col("pb") >= 2 * least)

    def name(x: Column) -> Column:
        mates = F.filter("branch", lambda y: y["k"] == x["k"])
        size = F.aggregate(mates, F.lit(0).cast("long"), lambda a, y: a + y["kinds"])
        open_ = F.exists(mates, lambda y: y["bin"] == -1) | ~many
        return F.when(size == 1, F.lit(None).cast("string")).when(open_, "*").otherwise(F.concat(F.lit("*"), x["k"].cast("string")))

    named = nodes.select(*node, F.col("all").alias("kinds"), many.alias("splits"), may_split.alias("may_split"), F.explode(F.transform("branch", lambda x: F.struct(x["bin"].alias("bin"), name(x).alias("name")))).alias("x"))
    both = child.join(named.select(*node, "kinds", "splits", "may_split", F.col("x.bin").alias("bin"), F.col("x.name").alias("name")), [*node, "bin"])
    return both.select(*node, "seg", "kinds", F.coalesce("name", "seg").alias("name"), "splits", "may_split")


def templates(paths: DataFrame, depth: int = 4, z: float = 2.58, least: int = 20) -> DataFrame:
    """paths (host, segs, pages, good, bad) with its template, a column of that name."""
    out = paths.withColumn("template", F.lit(""))
    for level in range(depth):
        out = out.withColumn("seg", F.get("segs", F.lit(level)))
        step = _children(out, z, least).select("host", "template", "seg", F.concat("template", F.lit("/"), "name").alias("grown"))
        grown = out.join(step, ["host", "template", "seg"], "left").withColumn("template", F.coalesce("grown", "template")).drop("grown", "seg")
        out = stored(grown, "templates")  # each level reads the one before twice
    # below, names are kept up to the last node that splits; a path that ends is a child of its own, an empty segment
    out, level = out.withColumns({"cut": F.col("template"), "whole": F.lit(False), "open": F.size("segs") > depth}), depth
    while out.where(F.col("open") & (F.size("segs") > level)).limit(1).count():
        out = out.withColumn("seg", F.when(F.col("open"), F.coalesce(F.get("segs", F.lit(level)), F.lit(""))))
        ends = F.col("seg") == ""
        joined = out.join(_children(out, z, least), ["host", "template", "seg"], "left")
        grown = F.when(~F.col("open") | ends, F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        splits = F.coalesce("splits", F.lit(False))
        new = joined.select("host", "segs", "pages", "good", "bad", grown.alias("template"), F.when(splits, grown).otherwise(F.col("cut")).alias("cut"), (F.col("whole") | (splits & F.coalesce(ends, F.lit(False)))).alias("whole"), (F.col("open") & F.coalesce(F.col("may_split") & ~ends, F.lit(False))).alias("open"))
        out, level = stored(new, "templates"), level + 1
    deep = F.when(F.col("whole"), F.col("cut")).otherwise(F.concat("cut", F.lit("/**")))
    return out.withColumn("template", F.when(F.size("segs") > depth, deep).otherwise(F.col("template"))).drop("cut", "whole", "open")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = (), purity: float = 0.5, weight: float = 4.0, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    ``labels`` (page_id, bad boolean) covers some pages; ``weight`` is how many labels a host's share counts as.
    """
    host, path = host_path(F.col("url"))
    seg = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), typed)
    page = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("segs", seg)
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = page.select("page_id", "host", "segs").join(known, "page_id", "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    paths = stored(marked.groupBy("host", "segs").agg(F.count("*").alias("pages"), one(F.col("bad") == F.lit(False)).alias("good"), one(F.col("bad")).alias("bad")), "paths")
    tree_of = templates(paths, **tree)
    total = paths.agg(F.sum("good").alias("ag"), F.sum("bad").alias("ab")).withColumn("k", F.lit(0))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb")).withColumn("k", F.lit(0))
    every = (F.col("ag") + 1) / (F.col("ag") + F.col("ab") + 2)
    hosts = hosts.join(F.broadcast(total), "k").select("host", ((F.col("hg") + weight * every) / (F.col("hg") + F.col("hb") + weight)).alias("hp"))
    found = tree_of.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb")).join(hosts, "host")
    found = found.select("host", "template", ((F.col("tg") + weight * F.col("hp")) / (F.col("tg") + F.col("tb") + weight)).alias("purity"))
    known_path = tree_of.select("host", "segs", "template").join(found, ["host", "template"])
    name, verdict = rule_of(F.col("host"), F.col("path"), list(rules))
    out = page.join(known_path, ["host", "segs"], "left")
    own = F.when((F.col("host") != "") & (F.col("purity") < purity), "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages: a page's last path segment names its document; bad is toxic or of low quality."""
    doc = F.regexp_extract(host_path(F.col("url"))[1], r"/([0-9]{1,18})(\.[A-Za-z0-9]+)?/?$", 1)
    named = pages.select("page_id", F.when(doc != "", doc).cast("long").alias("doc_id"))
    bad = labels.select("doc_id", (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    return named.join(bad, "doc_id").select("page_id", "bad")


#: The rules of the query op1_urls.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def sql(rules: list[tuple[str, str, str]] = RULES, purity: float = 0.5, weight: float = 4.0, depth: int = 4, z: float = 2.58, least: int = 20) -> str:
    """DuckDB SQL for judge() over the tables pages and labels."""
    ctes = [
        r"""u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
 h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
 pg as (select *, [regexp_replace(s, '^[0-9]+(\.[A-Za-z0-9]+)?$', '<n>\1') for s in string_split(path, '/') if s <> ''] segs,
  try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(\.[A-Za-z0-9]+)?/?$', 1), '') as bigint) doc_id from h),
 lb as (select doc_id, coalesce(toxic = 1, false) or coalesce(quality = 0, false) bad from labels),
 kn as (select page_id, max(bad) bad from pg join lb using (doc_id) where page_id is not null group by page_id),
 t0 as (select host, segs, '' as template, count(*) pages, count(*) filter (where bad = false) good, count(*) filter (where bad) bad from pg left join kn using (page_id) group by host, segs)"""
    ]
    for k in range(depth):
        n1, n2, share = "(a.g + a.b)", "(x.g + x.b)", "((a.b + x.b) / (a.g + a.b + x.g + x.b))"
        apart = f"coalesce({n1} >= {least} and {n2} >= {least} and not x.few and {share} > 0 and {share} < 1 and pow(a.b / {n1} - x.b / {n2}, 2) >= {z * z} * {share} * (1 - {share}) * (1 / {n1} + 1 / {n2}), false)"
        ctes.append(f"""c{k} as (select *, case when g + b >= {least} then cast(floor({BINS} * b / (g + b)) as int) else -1 end bin
  from (select host, template, segs[{k + 1}] seg, sum(good)::bigint g, sum(bad)::bigint b from t{k} where len(segs) > {k} group by all)),
 i{k} as (select host, template, bin, sum(g)::bigint g, sum(b)::bigint b, count(*) kinds from c{k} group by all),
 l{k} as (select host, template, sum(kinds) kinds, list({{'bin': bin, 'kinds': kinds, 'g': g, 'b': b, 'few': bin = -1 and g + b < {least}, 'k': 0, 'ks': [0]}}
  order by case when bin = -1 and g + b > 0 then {BINS} * b / (g + b) else bin end, bin) items from i{k} group by all),
 r{k} as (select host, template, kinds, items, list_reduce(items, lambda a, x: case when {apart}
  then {{'bin': 0, 'kinds': 0, 'g': x.g, 'b': x.b, 'few': false, 'k': a.k + 1, 'ks': list_append(a.ks, a.k + 1)}}
  else {{'bin': 0, 'kinds': 0, 'g': a.g + x.g, 'b': a.b + x.b, 'few': false, 'k': a.k, 'ks': list_append(a.ks, a.k)}} end) r from l{k}),
 e{k} as (select host, template, r.k > 0 many, unnest(items).bin bin, unnest(items).kinds kinds, unnest(r.ks) k from r{k}),
 b{k} as (select host, template, k, sum(kinds) size, bool_or(bin = -1) or not any_value(many) open_ from e{k} group by all),
 s{k} as (select c.host, c.template, c.seg, c.template || '/' || case when size = 1 then c.seg when open_ then '*' else '*' || e.k end grown
  from c{k} c join e{k} e on c.host = e.host and c.template = e.template and c.bin = e.bin join b{k} b on b.host = e.host and b.template = e.template and b.k = e.k),
 t{k + 1} as (select t.host, t.segs, coalesce(grown, t.template) as template, pages, good, bad from t{k} t left join s{k} s on t.host = s.host and t.template = s.template and t.segs[{k + 1}] = s.seg)""")
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in by_length)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in by_length)
    ctes.append(f"""tt as (select host, segs, template || case when len(segs) > {depth} then '/**' else '' end as template, good, bad from t{depth}),
 hp as (select host, (sum(good) + {weight} * (select (sum(good) + 1) / (sum(good) + sum(bad) + 2) from t0)) / (sum(good) + sum(bad) + {weight}) hp from t0 group by host),
 tp as (select host, template, (sum(good) + {weight} * any_value(hp)) / (sum(good) + sum(bad) + {weight}) purity from tt join hp using (host) group by host, template)""")
    return (
        "with " + ",\n ".join(ctes) + f"""
select page_id, pg.host, path, case {name} end as rule, case {verdict} when pg.host <> '' and purity < {purity} then 'block' else 'allow' end verdict, tp.template, round(purity, 9) purity
from pg left join tt on pg.host = tt.host and pg.segs = tt.segs left join tp on tt.host = tp.host and tt.template = tp.template""".replace("(host =", "(pg.host =").replace("ends_with(host", "ends_with(pg.host")
    )
