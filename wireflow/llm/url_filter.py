"""URL filter by empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import staged, table

#: (host, path, verdict); a rule's name is host + path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Public suffixes of two labels, under which anyone can register a name or a site. A parameter; more can be given.
LONG_SUFFIXES: tuple[str, ...] = tuple((
    "ac.id ac.il ac.in ac.jp ac.kr ac.nz ac.th ac.uk ac.za asso.fr co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.eg com.hk com.mx "
    "com.my com.ng com.pe com.ph com.pk com.pl com.pt com.ru com.sa com.sg com.tr com.tw com.ua com.vn edu.au edu.br edu.cn edu.hk edu.in edu.mx edu.pl edu.sg edu.tr edu.tw firm.in "
    "go.id go.jp go.kr go.th gob.ar gob.mx gov.au gov.br gov.cn gov.il gov.in gov.pl gov.sg gov.tr gov.tw gov.ua gov.uk gov.za govt.nz id.au ltd.uk me.uk ne.jp net.au net.br net.cn net.in "
    "net.nz net.pl net.tr net.uk nom.br or.id or.jp or.kr or.th org.ar org.au org.br org.cn org.hk org.il org.in org.mx org.nz org.pl org.sg org.tr org.tw org.ua org.uk org.za plc.uk sch.uk "
    "blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev tumblr.com vercel.app weebly.com wixsite.com wordpress.com").split())
#: A host is blocked if the lower bound of its rate of bad pages is above this.
MAX_BAD_RATE, BOUND_SDS = 0.4, 2.0


def url_parts(url: str) -> tuple[F.Column, F.Column]:
    """(host, path) of a url column; both empty for null or without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(F.col(url), whole, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(F.col(url), whole, 2), F.lit(""))


def suffix_and_domain(host: str, long_suffixes=LONG_SUFFIXES) -> tuple[F.Column, F.Column]:
    """The last label (or a listed longer suffix) and that with one label more."""
    suffix = F.substring_index(host, ".", -1)
    for n in sorted({s.count(".") + 1 for s in long_suffixes}):
        last = F.substring_index(host, ".", -n)
        suffix = F.when(last.isin(*[s for s in long_suffixes if s.count(".") + 1 == n]), last).otherwise(suffix)
    labels = F.size(F.split(suffix, r"\.")) + 1
    return suffix, F.array_join(F.slice(F.split(F.col(host), r"\."), F.greatest(F.size(F.split(F.col(host), r"\.")) - labels + 1, F.lit(1)), labels), ".")


def rule_columns(rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _shrunk(level: DataFrame, parent: DataFrame, key: str, up: str, label: str) -> DataFrame:
    """Posterior of each row of ``level`` (key, up, n, bad) with its parent's posterior mean as prior mean.

    The prior's strength, common to the level, comes by moments from the spread of the
    children's rates about their parents' (between 2 and 1000 pages)."""
    joined = staged(level.join(parent.select(F.col(up), F.col("rate").alias("m")), up), label)
    gap = F.col("bad") / F.col("n") - F.col("m")
    noise = F.col("m") * (1 - F.col("m"))
    s = joined.where("n > 0").agg(F.sum(F.col("n") * gap * gap).alias("ss"), F.sum(noise).alias("noise"), F.sum(noise * F.col("n")).alias("var"), F.sum("n").alias("pages"))
    s = s.select(F.coalesce(F.least(F.greatest(F.col("var") / F.greatest(F.col("ss") - F.col("noise"), F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(1000.0)), F.lit(2.0)).alias("s"))
    return joined.join(F.broadcast(s)).withColumn("rate", (F.col("bad") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))).withColumn(
        "sd", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("s") + 1)))


def reputations(parsed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, sd, host_blocked) for every host of ``parsed`` (page_id, host).

    ``outcomes``: (page_id, bad int). Beta-binomial priors run from all pages to the suffix,
    from the suffix to the registered domain and from there to the host."""
    suffix, domain = suffix_and_domain("host")
    hosts = staged(parsed.join(outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                   .withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix").withColumn("all", F.lit(1))
    everything = suffixes.groupBy("all").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("rate"))
    top = _shrunk(suffixes, everything, "suffix", "all", "suffixes")
    mid = _shrunk(domains, top, "domain", "suffix", "domains")
    low = _shrunk(hosts.drop("suffix"), mid.select("domain", "rate"), "host", "domain", "low")
    return low.select("host", "n", "bad", "rate", "sd", (F.col("rate") - BOUND_SDS * F.col("sd") > MAX_BAD_RATE).alias("host_blocked"))


def url_filter(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_rate, host_bound.

    A rule that fits decides; else the host's posterior bound: the mean of its beta posterior less
    two of its standard deviations. A null url has an empty host, which is a host like any other; a
    null page_id has no outcome; repeated rows are judged each; a long url is read whole; of several
    (tied) outcomes of a page the bad one counts; empty tables give no rows; other columns, whatever
    their names, are not read."""
    host, path = url_parts("url")
    parsed = staged(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path")), "urls")
    judged = staged(reputations(parsed.select("page_id", "host"), outcomes), "reputation")
    rule, verdict = rule_columns(rules)
    return (parsed.join(judged, "host", "left").withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("host_blocked"), "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", F.col("rate").alias("host_rate"), (F.col("rate") - BOUND_SDS * F.col("sd")).alias("host_bound")))


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): a labelled page is bad if its quality is 0 or it is toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`url_filter` of the whole pages table with the outcomes of the labels table."""
    found = url_filter(table(spark, sf_dir, "pages"), labelled_outcomes(table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
SQL = {"op1_url_filter": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
l AS (SELECT *, string_split(host, '.') AS labels, array_to_string(string_split(host, '.')[-2:], '.') IN (""" + _LONG + r""") AS long FROM p),
h AS (SELECT host, CASE WHEN long THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix, array_to_string(CASE WHEN long THEN labels[-3:] ELSE labels[-2:] END, '.') AS domain,
             count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM l LEFT JOIN o USING (page_id) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
a AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM s),
s1 AS (SELECT suffix, n, bad, m FROM s, a),
ss AS (SELECT coalesce(least(greatest(sum(m * (1 - m) * n) / greatest(sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m)), 1e-9) - 1, 2.0), 1000.0), 2.0) AS s FROM s1 WHERE n > 0),
sp AS (SELECT suffix, (bad + s * m) / (n + s) AS m FROM s1, ss),
d1 AS (SELECT domain, n, bad, m FROM d JOIN sp USING (suffix)),
ds AS (SELECT coalesce(least(greatest(sum(m * (1 - m) * n) / greatest(sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m)), 1e-9) - 1, 2.0), 1000.0), 2.0) AS s FROM d1 WHERE n > 0),
dp AS (SELECT domain, (bad + s * m) / (n + s) AS m FROM d1, ds),
h1 AS (SELECT host, n, bad, m FROM h JOIN dp USING (domain)),
hs AS (SELECT coalesce(least(greatest(sum(m * (1 - m) * n) / greatest(sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m)), 1e-9) - 1, 2.0), 1000.0), 2.0) AS s FROM h1 WHERE n > 0),
hp AS (SELECT host, n + s AS size, (bad + s * m) / (n + s) AS r FROM h1, hs),
v AS (SELECT host, r - 2.0 * sqrt(r * (1 - r) / (size + 1)) > 0.4 AS blocked FROM hp),
r AS (SELECT p.*, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM r JOIN v USING (host)"""}
