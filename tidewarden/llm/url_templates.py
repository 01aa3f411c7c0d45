"""URL filter: listed rules, and per host a tree of path templates judged by their labelled purity.

A path is cut at its slashes; runs of digits and long hexadecimal segments become placeholders at
once. Equal results are counted per host, with how many of them are labelled bad and good, and all
that follows works on these counts. From the root of each host the tree grows level by level:

* the segments that follow a node are its branches, the end of the path being one too. If a node has
  more than ``FAN`` of them, those that hold less than 1 / ``FAN`` of its paths are a variable and
  go together as one wildcard;
* a branch whose share of bad labels differs from that of its siblings together (chi-squared test,
  ``DIFFERS``) goes with those that differ the same way; the others are similar and merge as well. So
  a node has at most four children, and statistics of merged branches are merged below, too;
* a child's purity is its share of bad labels, smoothed by ``WEIGHT`` labels of its parent's purity;
  a host's parent is the whole table.

A path is judged by the template it ends in: purity of ``REJECT`` or more rejects it. Without labels
of its own a url is thus judged by the nearest node that has some. In the registered query the
rules' verdicts are the labels; ``judge`` takes any.

Nodes of at most ``FAN`` + 2 rows are compared in windows; anything larger is aggregated, and joined
with salted keys, as a host or a template may hold a third of all rows. Rejected templates are
broadcast only while they are few and short.

Rows: a null url, or one without ``://``, has empty host and path; a path of more than ``DEPTH``
segments has the rest as its last one; null page_ids are rows like others; repeated rows are counted
and returned each; a table without labels rejects nothing; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import written

RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
ALLOW, BLOCK = "allow", "block"
DEPTH, FAN = 12, 24
DIFFERS = 6.635  # chi-squared, one degree of freedom, 1 %
WEIGHT, REJECT = 4.0, 0.7
SALTS = 16
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000
END, WILD = "$", "*"
SIMILAR, WORSE, BETTER = "*", "*-", "*+"


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``page_id, host, path`` of every row."""
    held = F.coalesce(url, F.lit(""))
    at = F.instr(held, "://")
    rest = F.when(at > 0, F.substr(held, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    return pages.select(
        "page_id",
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(after, r"^[^?#]*", 0).alias("path"),
    )


def first_rule(rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, or null. Made for lists that fit into a plan."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first, so it comes last here
        site, _, path = rule.partition("/")
        fits = ((F.col("host") == site) | F.endswith("host", F.lit("." + site))) & F.startswith("path", F.lit("/" + path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """Segments of a path, with placeholders for numbers and identifiers."""

    def shape(segment: Column) -> Column:
        identifier = segment.rlike(r"^[0-9A-Fa-f][0-9A-Fa-f-]{7,}$") & segment.rlike("[A-Fa-f]") & segment.rlike("[0-9]")
        return F.when(identifier, "{x}").otherwise(F.regexp_replace(segment, "[0-9]+", "{n}"))

    cut = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)
    tail = F.array_join(F.slice(cut, DEPTH, F.greatest(F.size(cut), F.lit(1))), "/")
    whole = F.when(F.size(cut) <= DEPTH, cut).otherwise(F.concat(F.slice(cut, 1, DEPTH - 1), F.array(tail)))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(whole)


def salted(left: DataFrame, right: DataFrame, by: list[str], over: str, how: str = "inner") -> DataFrame:
    """Join with ``right``, which has one row per ``by``; a key's rows on the left are dealt to ``SALTS`` parts."""
    spread = left.withColumn("salt__", F.pmod(F.xxhash64(over), F.lit(SALTS)))
    copies = right.withColumn("salt__", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return spread.join(copies, [*by, "salt__"], how).drop("salt__")


def grown(paths: DataFrame, level: int) -> DataFrame:
    """One level: ``host, node, purity, segments, bad, good, n`` with node and purity of the child each row goes to."""
    place = ["host", "node"]
    here = paths.withColumn("child", F.when(F.size("segments") <= level, END).otherwise(F.get("segments", F.lit(level))))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    kids = written(here.groupBy(*place, "child").agg(*sums, F.max("purity").alias("purity")), "url-kids")
    width = kids.groupBy(*place).agg(F.count(F.lit(1)).alias("width"), F.sum("n").alias("total"))
    variable = (F.col("width") > FAN) & (F.col("n") * FAN < F.col("total")) & (F.col("child") != END)
    named = salted(kids, width, place, "child").withColumn("branch", F.when(variable, WILD).otherwise(F.col("child")))
    named = written(named.drop("width", "total"), "url-branches")

    node = Window.partitionBy(*place)
    bad, good, every_bad, every_good = (F.col(c).cast("double") for c in ("bad", "good", "every_bad", "every_good"))
    labels, every = bad + good, every_bad + every_good
    apart = bad * (every_good - good) - good * (every_bad - bad)
    scale = labels * (every - labels) * every_bad * every_good
    differs = every * apart * apart > F.lit(DIFFERS) * scale
    side = F.when((scale > 0) & differs, F.when(apart > 0, WORSE).otherwise(BETTER)).otherwise(SIMILAR)
    family = Window.partitionBy(*place, "side")
    branches = named.groupBy(*place, "branch").agg(*sums, F.max("purity").alias("purity"))
    judged = (
        branches.withColumns({"every_bad": F.sum("bad").over(node), "every_good": F.sum("good").over(node)})
        # an end has nothing below it to merge
        .withColumn("side", F.when(F.col("branch") == END, END).otherwise(side))
        .withColumns(
            {"bad": F.sum("bad").over(family), "good": F.sum("good").over(family), "members": F.count(F.lit(1)).over(family)}
        )
        .select(
            *place,
            "branch",
            F.when(F.col("members") == 1, F.col("branch")).otherwise(F.col("side")).alias("step"),
            ((F.col("bad") + F.lit(WEIGHT) * F.col("purity")) / (F.col("bad") + F.col("good") + F.lit(WEIGHT))).alias("fresh"),
        )
    )
    to_child = salted(named.select(*place, "child", "branch"), judged, [*place, "branch"], "child").drop("branch")
    moved = salted(here, to_child, [*place, "child"], "segments")
    return moved.select(
        "host", F.concat("node", F.lit("/"), "step").alias("node"), F.col("fresh").alias("purity"), "segments", "n", "bad", "good"
    )


def templates(labelled: DataFrame) -> DataFrame:
    """``host, segments, template, purity, n, bad, good`` of every different path, from ``host, path, bad``.

    ``bad`` is true or false where a url is labelled, else null.
    """
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")]
    paths = written(labelled.groupBy("host", shapes(F.col("path")).alias("segments")).agg(*counts), "url-paths")
    hosts = paths.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("good").alias("host_good"))
    whole = paths.agg(
        ((F.sum("bad") + F.lit(WEIGHT) * 0.5) / (F.sum("bad") + F.sum("good") + F.lit(WEIGHT))).alias("p")
    )
    prior = F.coalesce(whole.scalar(), F.lit(0.5))
    host_purity = (F.col("host_bad") + F.lit(WEIGHT) * prior) / (F.col("host_bad") + F.col("host_good") + F.lit(WEIGHT))
    rooted = hosts.select("host", F.lit("").alias("node"), host_purity.alias("purity"))
    active = written(salted(paths, rooted, ["host"], "segments"), "url-level")
    deepest = active.agg(F.max(F.size("segments"))).first()[0]
    done = []
    for level in range((deepest or 0) + 1):
        stepped = written(grown(active, level), "url-level")
        done.append(stepped.filter(F.size("segments") <= level))
        active = stepped.filter(F.size("segments") > level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("node", "template")


def judge(urls: DataFrame, labelled: DataFrame, reject: float = REJECT) -> DataFrame:
    """Add ``method``: block if the url's template is rejected, else allow. ``urls`` has ``host`` and ``path``."""
    found = templates(labelled).filter(F.col("purity") >= reject).select("host", "segments")
    found = written(found.withColumn("rejected", F.lit(True)), "url-rejected")
    size = found.agg(F.count(F.lit(1)), F.sum(F.length("host") + F.length(F.array_join("segments", "/")))).first()
    shaped = urls.withColumn("segments", shapes(F.col("path")))
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_CHARS:
        joined = shaped.join(F.broadcast(found), ["host", "segments"], "left")
    else:
        joined = salted(shaped, found, ["host", "segments"], "path", "left")
    return joined.select(*urls.columns, F.when(F.col("rejected"), BLOCK).otherwise(ALLOW).alias("method"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page: the rule's verdict, else that of its template."""
    urls = parts(pages).withColumn("rule", first_rule(rules))
    known = urls.withColumn("said", rule_verdict(F.col("rule"), rules))
    judged = judge(known, known.select("host", "path", (F.col("said") == BLOCK).alias("bad")))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", "method").alias("verdict"))


def filter_sql(source: str = "pages", rules: list[tuple[str, str]] = RULES) -> str:
    """The rows of ``filter_urls`` in DuckDB SQL: every level is a few tables of its own."""
    rule = said = "NULL"
    for _, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, _, path = text.partition("/")
        fits = f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{path}')"
        rule = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END"
    for verdict, text in rules:
        said = f"CASE WHEN rule = '{text}' THEN '{verdict}' ELSE {said} END"
    shape = (
        "CASE WHEN regexp_matches(s, '^[0-9A-Fa-f][0-9A-Fa-f-]{7,}$') AND regexp_matches(s, '[A-Fa-f]') AND regexp_matches(s, '[0-9]') "
        "THEN '{x}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END"
    )
    weight = f"{WEIGHT}::DOUBLE"
    tables = [
        f"""u0 AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {source}),
u1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u0),
u2 AS (SELECT page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM u1),
u3 AS (SELECT *, {rule} AS rule FROM u2),
u4 AS (SELECT *, {said} AS said, list_transform(CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END, lambda s: {shape}) AS cut FROM u3),
u5 AS MATERIALIZED (SELECT *, CASE WHEN len(cut) <= {DEPTH} THEN cut ELSE list_append(cut[1:{DEPTH - 1}], array_to_string(cut[{DEPTH}:], '/')) END AS segs FROM u4),
p0 AS MATERIALIZED (SELECT host, segs, count(*)::BIGINT AS n, count(*) FILTER (said = '{BLOCK}')::BIGINT AS bad, count(*) FILTER (said = '{ALLOW}')::BIGINT AS good FROM u5 GROUP BY ALL),
pr AS (SELECT (coalesce(sum(bad), 0) + {weight} * 0.5::DOUBLE) / (coalesce(sum(bad), 0) + coalesce(sum(good), 0) + {weight}) AS p FROM p0),
ph AS (SELECT host, (sum(bad) + {weight} * any_value(p)) / (sum(bad) + sum(good) + {weight}) AS purity FROM p0, pr GROUP BY 1),
a0 AS MATERIALIZED (SELECT host, '' AS node, purity, segs, n, bad, good FROM p0 JOIN ph USING (host))"""
    ]
    for i in range(DEPTH + 1):
        tables.append(
            f"""h{i} AS MATERIALIZED (SELECT *, CASE WHEN len(segs) <= {i} THEN '{END}' ELSE segs[{i + 1}] END AS child FROM a{i}),
k{i} AS (SELECT host, node, child, sum(n) AS n, sum(bad) AS bad, sum(good) AS good, max(purity) AS purity FROM h{i} GROUP BY 1, 2, 3),
b{i} AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER o > {FAN} AND n * {FAN} < sum(n) OVER o AND child <> '{END}' THEN '{WILD}' ELSE child END AS branch FROM k{i} WINDOW o AS (PARTITION BY host, node)),
j{i} AS (SELECT *, sum(bad) OVER o AS every_bad, sum(good) OVER o AS every_good FROM (SELECT host, node, branch, sum(bad) AS bad, sum(good) AS good, max(purity) AS purity FROM b{i} GROUP BY 1, 2, 3) WINDOW o AS (PARTITION BY host, node)),
x{i} AS (SELECT *, (bad * (every_good - good) - good * (every_bad - bad))::DOUBLE AS apart, (every_bad + every_good)::DOUBLE AS every, ((bad + good) * (every_bad + every_good - bad - good))::DOUBLE * every_bad::DOUBLE * every_good::DOUBLE AS scale FROM j{i}),
s{i} AS (SELECT *, CASE WHEN branch = '{END}' THEN '{END}' WHEN scale > 0 AND every * apart * apart > {DIFFERS}::DOUBLE * scale THEN CASE WHEN apart > 0 THEN '{WORSE}' ELSE '{BETTER}' END ELSE '{SIMILAR}' END AS side FROM x{i}),
f{i} AS MATERIALIZED (SELECT host, node, branch, CASE WHEN count(*) OVER o = 1 THEN branch ELSE side END AS step, (sum(bad) OVER o + {weight} * purity) / (sum(bad) OVER o + sum(good) OVER o + {weight}) AS fresh FROM s{i} WINDOW o AS (PARTITION BY host, node, side)),
m{i} AS MATERIALIZED (SELECT host, node || '/' || step AS node, fresh AS purity, segs, h{i}.n, h{i}.bad, h{i}.good FROM h{i} JOIN (SELECT host, node, child, branch FROM b{i}) USING (host, node, child) JOIN f{i} USING (host, node, branch)),
a{i + 1} AS (SELECT * FROM m{i} WHERE len(segs) > {i})"""
        )
    done = " UNION ALL ".join(f"SELECT host, segs, purity FROM m{i} WHERE len(segs) <= {i}" for i in range(DEPTH + 1))
    return (
        "WITH "
        + ",\n".join(tables)
        + f""",
fin AS (SELECT host, segs FROM ({done}) WHERE purity >= {REJECT})
SELECT page_id, u5.host, path, rule, coalesce(said, CASE WHEN fin.host IS NULL THEN '{ALLOW}' ELSE '{BLOCK}' END) AS verdict FROM u5 LEFT JOIN fin ON u5.host = fin.host AND u5.segs = fin.segs"""
    )
