"""URL filters: rules on host and path, and an empirical-Bayes reputation of hosts where no rule fits.

A page's outcome (1 bad, 0 good, null unknown) is by default what the rules say of it; a caller may give a column of its
own. Outcomes are counted by host, registered domain and suffix. Each level is beta-binomial: a host's prior has the mean
of its domain and a strength worked out from how far hosts stray from their domains (moments over all hosts); the domain
shrinks to its suffix likewise, the suffix to an even prior, so a suffix without outcomes tells nothing. A page without a rule is blocked if the share of bad pages of its host is
above LIMIT by a lower bound: the posterior's mean less Z of its standard deviations.

Only the url is read. Pages are counted before they move (one row a host and task); reputations come back to pages by
host, hosts of a thousandth of all pages or more by broadcast (a thousand at most), so no host meets in one task.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and a suffix of their own, the empty one;
empty tables give no rows; repeated rows and ids are judged each by itself and counted each; a rule's path must begin
the url's path, so an empty path fits no rule with a path; of rules of equal length that of the longer host wins, then
the first given. Without any outcome nothing is known to be bad, and all is allowed. Ports and user names are part of the
host (as the rules see it), but not of its registered domain; an address of numbers is its own domain and suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, looked_up, stored

#: Suffixes of two labels under which names are registered. Others have one label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx", "co.kr")

#: A host is blocked where its share of bad pages is surely above this ...
LIMIT = 0.5
#: ... by so many standard deviations of the posterior.
Z = 1.645
#: Outcomes that the even prior of a suffix weighs as.
EVEN = 2.0
#: Hosts of more than 1/HOT of all pages (so fewer than HOT hosts) are broadcast.
HOT = 1000


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for host, its subdomains, and paths that begin with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule(verdict: str, place: str) -> Rule:
    """As ``rule("block", "example.com/en/")``."""
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"a rule is allow or block, and a host with a path: {verdict} {place}")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or hash; A-Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain (the suffix and one label more)."""
    name = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    two, number = last(2).isin(*suffixes), name.rlike(r"^[0-9.]+$|^\[.*\]$")
    return F.when(number, name).when(two, last(2)).otherwise(last(1)), F.when(number, name).when(two, last(3)).otherwise(last(2))


def with_rule(pages: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, url, host, path, rule, ruled): the longest rule that fits and its verdict."""
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: (len(r.name), len(r.host))):  # the last that fits stays, so the longest
        fits = r.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return out.select("*", name.alias("rule"), verdict.alias("ruled"))


def _strength(units: DataFrame, parent: Column) -> float:
    """The beta prior's alpha + beta, from how far the shares of units (n, bad) stray from their parent's mean.

    Moments: E[(bad - n m)^2] = n m (1-m) (1 + (n-1) r), with r = 1 / (strength + 1)."""
    m = parent
    got = units.agg(
        F.sum((F.col("bad") - F.col("n") * m) * (F.col("bad") - F.col("n") * m) - F.col("n") * m * (1 - m)).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("most"),
    ).first()
    r = got["over"] / got["most"] if got["most"] else 0.0
    r = min(0.5, max(0.001, r))  # a prior weighs as much as one page at least, so one page alone convicts nobody
    return (1 - r) / r


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, domain, suffix, pages, n, bad) with mean and bound of the posterior share of bad pages."""
    held = hosts.count()
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("hosts").alias("hosts")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums[:2], F.count("*").alias("hosts")), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums)

    def shrunk(mean: Column, strength: float) -> Column:
        return (mean * strength + F.col("bad")) / (F.col("n") + strength)

    by_suffix = suffixes.select("suffix", shrunk(F.lit(0.5), EVEN).alias("suffix_mean"), F.col("hosts").alias("of_suffix"))
    under = looked_up(domains, by_suffix, "suffix", F.col("of_suffix") * HOT > held, F.col("domain"))
    d = _strength(under, F.col("suffix_mean"))
    by_domain = under.select("domain", shrunk(F.col("suffix_mean"), d).alias("domain_mean"), F.col("hosts").alias("of_domain"))
    both = looked_up(hosts, by_domain, "domain", F.col("of_domain") * HOT > held, F.col("host"))
    h = _strength(both, F.col("domain_mean"))
    mean = shrunk(F.col("domain_mean"), h)
    weight = F.col("n") + h
    out = stored(both.select("host", "domain", "suffix", "pages", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bound")), "reputations")
    discard(domains)
    return out


def judged(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url", outcome: Column | None = None, limit: float = LIMIT) -> DataFrame:
    """(id_col, host, path, rule, verdict, host_pages, known_pages, bad_pages, mean, bound) of each page.

    rules are compiled into one expression: a list of hundreds, not of millions. outcome: a column over
    (id, url, host, path, rule, ruled)."""
    seen = with_rule(pages, id_col, url_col, rules)
    bad = (F.col("ruled") == "block").cast("long") if outcome is None else outcome.cast("long")
    counted = seen.select("host", bad.alias("bad")).groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = stored(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "bad"), "hosts")
    rows = hosts.agg(F.sum("pages")).first()[0] or 0
    known = reputations(hosts).select("host", "pages", "n", "bad", "mean", "bound")
    discard(hosts)
    out = looked_up(seen, known, "host", F.col("pages") * HOT > rows, F.struct("id", "url"))
    verdict = F.coalesce("ruled", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.col("pages").alias("host_pages"), F.col("n").alias("known_pages"), F.col("bad").alias("bad_pages"), "mean", "bound")


#: The registered query's rules.
RULES = (rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/"))

#: The registered query in DuckDB's SQL.
JUDGED_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(ruled, rhost, rpath)),
s AS (SELECT p.*, rhost || rpath AS rule, ruled FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) = 1),
h AS (SELECT host, count(*) AS pages, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS bad, string_split(regexp_replace(host, '^.*@|:[0-9]*$', ''), '.') AS l FROM s GROUP BY host),
g AS (SELECT *, l[-1] AS suffix, CASE WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS domain FROM h),
ps AS (SELECT suffix, (1 + sum(bad)) / (2 + sum(n)) AS ms FROM g GROUP BY suffix),
fd AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(ms) AS m FROM g JOIN ps USING (suffix) GROUP BY domain, suffix),
rd AS (SELECT least(0.5, greatest(0.001, coalesce(sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) AS r FROM fd),
pd AS (SELECT domain, (m * (1 - r) / r + bad) / (n + (1 - r) / r) AS m FROM fd, rd),
fh AS (SELECT host, n, bad, m FROM g JOIN pd USING (domain)),
rh AS (SELECT least(0.5, greatest(0.001, coalesce(sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) AS r FROM fh),
ph AS (SELECT host, n + (1 - r) / r AS w, (m * (1 - r) / r + bad) / (n + (1 - r) / r) AS mean FROM fh, rh)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM s JOIN ph USING (host)
"""
