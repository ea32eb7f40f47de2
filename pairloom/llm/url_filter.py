"""URL filter: rules by host and path, then an empirical-Bayes reputation of hosts.

A url that no rule fits is judged by its host. The outcomes of labelled pages (here: those that a
rule has decided, block = 1) are counted by host, registered domain and suffix. Rates shrink from
the whole to suffixes, to domains, to hosts: each level's posterior mean is the beta prior's mean
one level down, and the prior's strength comes from the spread of the rates at that level (method
of moments for the beta-binomial). A host is blocked if the lower bound of its posterior rate,
mean - z * sd, reaches the threshold.

Null url, or one without '://': host and path are empty, no rule fits, and the host '' is judged
like any other. Repeated rows are judged alike, each counting as an outcome. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_RULES = 1000  # they are compiled into one expression
MIN_STRENGTH, MAX_STRENGTH = 1.0, 100.0
Z, THRESHOLD = 1.645, 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shrunk(counts: DataFrame, parent: DataFrame | None, by: str, up: str | None) -> DataFrame:
    """by, n, k -> and m (posterior mean), a, b. parent has the column up and its m."""
    total = counts.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    spread = counts.where("n > 0").agg(F.avg(F.col("k") / F.col("n")).alias("mu"), F.var_pop(F.col("k") / F.col("n")).alias("var"))
    both = total.join(spread)  # a row each
    s = F.least(F.greatest(F.coalesce(F.col("mu") * (1 - F.col("mu")) / F.when(F.col("var") > 1e-12, F.col("var")) - 1, F.lit(MAX_STRENGTH)), F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))
    level = both.select(s.alias("s"), F.coalesce(F.col("tk") / F.when(F.col("tn") > 0, F.col("tn")), F.lit(0.0)).alias("g"))
    s_value, g_value = level.select("s").scalar(), level.select("g").scalar()
    df = counts
    if parent is None:
        prior = g_value
    else:
        df = df.join(parent.select(F.col(up), F.col("m").alias("pm")), up)
        prior = F.col("pm")
    a, b = F.col("k") + s_value * prior, F.col("n") - F.col("k") + s_value * (1 - prior)
    df = df.withColumn("a", a).withColumn("b", b)
    return df.withColumn("m", F.col("a") / (F.col("a") + F.col("b")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, bad (0, 1 or null). Returns host, m, low: the posterior mean and its lower bound."""
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*\z", 0))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )
    up = lambda by, *more: hosts.groupBy(by, *more).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = shrunk(up("suffix"), None, "suffix", None)
    domains = shrunk(up("domain", "suffix"), suffixes, "domain", "suffix")
    out = shrunk(hosts.drop("suffix"), domains, "host", "domain")
    t = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1)))
    return out.select("host", "m", (F.col("m") - Z * sd).alias("low"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and score: the lower bound of the host's rate of blocked outcomes."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    ruled = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    hosts = reputation(ruled.select("host", (F.col("ruled") == "block").cast("int").alias("bad")))
    by_host = F.when(F.col("low") >= threshold, "block").otherwise("allow")
    return ruled.join(hosts, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    when = lambda out: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ) + " ELSE NULL END"
    level = lambda name, src, by, prior: f"""
    {name}_s AS (SELECT least(greatest(coalesce(mu * (1 - mu) / CASE WHEN var > 1e-12 THEN var END - 1, {MAX_STRENGTH}::DOUBLE), {MIN_STRENGTH}::DOUBLE), {MAX_STRENGTH}::DOUBLE) AS s
      FROM (SELECT avg(k / n) AS mu, var_pop(k / n) AS var FROM {src} WHERE n > 0)),
    {name} AS (SELECT *, a / (a + b) AS m FROM (SELECT c.{by}, {"c.suffix, " if name == "domains" else ""}c.k + s * {prior} AS a, c.n - c.k + s * (1 - {prior}) AS b
      FROM {src} c CROSS JOIN {name}_s """  # noqa: E731
    return f"""
WITH urls AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (SELECT page_id, host, path, {when(lambda v, h, p: h + p)} AS rule, {when(lambda v, h, p: v)} AS ruled FROM urls),
h AS (SELECT host, split_part(host, '.', -1) AS suffix,
        CASE WHEN strpos(host, '.') = 0 THEN host ELSE split_part(host, '.', -2) || '.' || split_part(host, '.', -1) END AS domain,
        count(ruled)::DOUBLE AS n, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END)::DOUBLE AS k
      FROM ruled GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
g AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS g FROM x),
{level("suffixes", "x", "suffix", "g.g")} CROSS JOIN g)),
{level("domains", "d", "domain", "u.m")} JOIN suffixes u USING (suffix))),
{level("hosts", "h", "host", "u.m")} JOIN domains u USING (domain)))
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN m - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN hosts USING (host)
"""
