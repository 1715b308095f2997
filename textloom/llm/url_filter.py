"""URL filters: explicit rules, then empirical-Bayes host reputation, in DataFrame functions only.

Labelled pages give each host n outcomes, k of them bad. Rates shrink through beta-binomial priors: the suffix's
towards the overall rate, the registered domain's towards its suffix's, the host's towards its domain's. Each level's prior strength
comes from the spread between its groups (the ANOVA estimate of the intra-class correlation). A host is
blocked when the lower ``alpha`` quantile of its posterior, a beta distribution, passes ``max_bad``: that is, when the posterior
probability of a bad rate of ``max_bad`` or less, the regularised incomplete beta function, is below ``alpha``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MAX_BAD = 0.2
ALPHA = 0.05
#: Steps of the continued fraction of the incomplete beta function; it settles in some times the root of the counts.
FRACTION_STEPS = 200
#: Second-level labels under which two-letter suffixes register names, unless the caller gives other suffixes.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or without ``://``: both empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of equally long ones a blocking rule goes first."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _bare(host: Column) -> Column:
    """A host without user, port and final dot."""
    own = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(own, r"\.+$", "")


def registered_domain(host: Column, suffixes=None) -> tuple[Column, Column]:
    """The registered domain of a host and its public suffix; an address is both by itself.

    ``suffixes``: public suffixes of two labels or more (``co.uk``); default: a label of ``SECOND_LEVEL`` under one of two letters. Every last label is a suffix too.
    """
    own = _bare(host)
    address = own.rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.startswith(own, F.lit("["))
    part = F.split(own, r"\.")
    if suffixes is None:
        deep = F.when((F.size(part) >= 3) & (F.length(F.element_at(part, -1)) == 2) & F.try_element_at(part, F.lit(-2)).isin(*SECOND_LEVEL), 2).otherwise(1)
    else:
        deep = F.lit(1)
        for n in sorted({s.count(".") + 1 for s in suffixes}):
            deep = F.when(F.substring_index(own, ".", -n).isin(*[s for s in suffixes if s.count(".") + 1 == n]), n).otherwise(deep)
    last = lambda n: F.array_join(F.slice(part, F.greatest(F.lit(1), F.size(part) - n + 1), F.size(part)), ".")
    return F.when(address, own).otherwise(last(deep + 1)), F.when(address, own).otherwise(last(deep))


def _log_gamma(z: Column) -> Column:
    """Stirling's series, eight steps up, where it has all digits."""
    up = z + 8
    series = (up - 0.5) * F.log(up) - up + 0.9189385332046727 + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    below = F.lit(0.0)
    for k in range(8):
        below = below + F.log(z + k)
    return series - below


def beta_cdf(x: float, a: Column, b: Column, steps: int = FRACTION_STEPS) -> Column:
    """The regularised incomplete beta function, by its continued fraction on the side where that is short."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(p: Column, q: Column, y: float) -> Column:
        d0 = 1 / safe(1 - (p + q) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("f"))

        def step(s, m):
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            half = F.struct(safe(1 + even / s["c"]).alias("c"), (1 / safe(1 + even * s["d"])).alias("d"), s["f"].alias("f"))
            other = lambda h: F.struct(safe(1 + odd / h["c"]).alias("c"), (1 / safe(1 + odd * h["d"])).alias("d"), (h["f"] * h["c"] * h["d"]).alias("f"))
            both = F.transform(F.array(half), lambda h: other(h))
            # the last product is taken with the new c and d
            return F.transform(F.transform(F.array(half), lambda h: F.struct(h["c"].alias("c0"), h["d"].alias("d0"), h["f"].alias("f"), both[0]["c"].alias("c"), both[0]["d"].alias("d"))), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (t["f"] * t["c0"] * t["d0"] * t["c"] * t["d"]).alias("f")))[0]

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double")), start, step, lambda s: s["f"])

    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * math.log(x) + b * math.log1p(-x))
    left = x < (a + 1) / (a + b + 2)
    # one fraction, with the sides changed where need be
    value = front * F.when(left, fraction(a, b, x) / a).otherwise(fraction(b, a, 1 - x) / b)
    return F.when(left, value).otherwise(1 - value)


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: the prior strength of a level, and the overall rate."""
    g = groups.where("n > 0").withColumn("p", F.col("k") / F.col("n"))
    s = g.agg(
        F.count("*").alias("groups"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("k").alias("bad"),
        F.sum(F.col("k") * F.col("p")).alias("between"), F.sum(F.col("k") * (1 - F.col("p"))).alias("within"),
    )
    mu = F.coalesce(F.try_divide("bad", "total"), F.lit(0.0))
    msb = F.try_divide(F.col("between") - F.col("bad") * mu, F.col("groups") - 1)
    msw = F.try_divide("within", F.col("total") - F.col("groups"))
    size = F.try_divide(F.col("total") - F.try_divide("squares", "total"), F.col("groups") - 1)
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.coalesce(F.try_divide(msb - msw, msb + (size - 1) * msw), F.lit(0.01))))
    return s.select(((1 - rho) / rho).alias(f"m_{level}"), mu.alias("mu"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD, alpha: float = ALPHA, suffixes=None) -> DataFrame:
    """``pages(page_id, host)``, ``outcomes(page_id, bad boolean)`` -> ``(host, n, k, mean, strength, tail, host_verdict)`` for every host: its posterior's mean and weight, and the
    posterior probability of a bad rate of ``max_bad`` or less.

    Hosts without labels follow their domain and suffix; the empty host is always allowed. Outcomes of null id or value are left out.
    """
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(labels, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    domain, suffix = registered_domain(F.col("host"), suffixes)
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    host, domain, suffix = (_strength(t, level).first() for t, level in ((hosts, "h"), (domains, "d"), (suffixes, "s")))
    shrunk = lambda k, n, m, to: (F.col(k) + m * to) / (F.col(n) + m)
    suffixes = suffixes.select("suffix", shrunk("k", "n", suffix["m_s"], F.lit(suffix["mu"])).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk("k", "n", domain["m_d"], F.col("p_suffix")).alias("p_domain"))
    all_hosts = hosts.join(domains, "domain")
    m = host["m_h"]
    mean = shrunk("k", "n", m, F.col("p_domain"))
    rows = all_hosts.select("host", "n", "k", F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), mean)).alias("mean"), (F.col("n") + m).alias("strength"))
    # far below the limit the tail is 1 to all digits that matter; elsewhere it is worked out
    near = F.col("mean") > max_bad / 4
    tail = F.when(near, beta_cdf(max_bad, F.col("mean") * F.col("strength"), (1 - F.col("mean")) * F.col("strength"))).otherwise(1.0)
    rows = rows.withColumn("tail", tail)
    return rows.withColumn("host_verdict", F.when((F.col("host") != "") & (F.col("mean") > max_bad) & (F.col("tail") < alpha), "block").otherwise("allow"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, alpha: float = ALPHA, suffixes=None) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``(page_id, host, path, rule, verdict, bad_rate)``, a row per input row, repeated rows too; ``bad_rate``: the host's posterior mean.

    Null urls and urls without ``://`` have an empty host and path and are allowed. Extra columns are not read. Empty tables give no rows.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = materialize(host_reputation(rows, outcomes, max_bad, alpha, suffixes), "reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(known.select("host", "mean", "host_verdict"), "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("host_verdict"), F.lit("allow")).alias("verdict"), F.round("mean", 9).alias("bad_rate"))


def _level_sql(level: str, table: str) -> str:
    """The prior strength of a level, from its groups' counts (n, k)."""
    return f"""s{level} AS (SELECT (1 - rho) / rho AS m, mu FROM (SELECT mu, least(0.5::DOUBLE, greatest(0.001::DOUBLE, coalesce((msb - msw) / nullif(msb + (size - 1) * msw, 0), 0.01::DOUBLE))) AS rho
  FROM (SELECT mu, (btw - bad * mu) / nullif(g - 1, 0) AS msb, wth / nullif(total - g, 0) AS msw, (total - squares / nullif(total, 0)) / nullif(g - 1, 0) AS size
    FROM (SELECT coalesce(sum(k)::DOUBLE / nullif(sum(n), 0), 0) AS mu, count(*)::DOUBLE AS g, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares, sum(k)::DOUBLE AS bad, sum(k * (k::DOUBLE / n)) AS btw, sum(k * (1 - k::DOUBLE / n)) AS wth FROM {table} WHERE n > 0))))"""


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: The posterior's tail by quadrature over 20,000 points, for hosts whose mean passes the limit.
ORACLE_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p), u AS (SELECT rid, page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
l AS (SELECT doc_id AS page_id, max(toxic) > 0 AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
c AS (SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS k, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS bare FROM u LEFT JOIN l USING (page_id) GROUP BY host),
d AS (SELECT *, string_split(bare, '.') AS part, regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') OR starts_with(bare, '[') AS address FROM c),
e AS (SELECT *, CASE WHEN len(part) >= 3 AND length(part[-1]) = 2 AND part[-2] IN {SECOND_LEVEL} THEN 2 ELSE 1 END AS deep FROM d),
hosts AS (SELECT host, n, k, CASE WHEN address THEN bare ELSE array_to_string(part[greatest(1, len(part) - deep):], '.') END AS domain, CASE WHEN address THEN bare ELSE array_to_string(part[greatest(1, len(part) - deep + 1):], '.') END AS suffix FROM e),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
{_level_sql("h", "hosts")}, {_level_sql("d", "domains")}, {_level_sql("s", "suffixes")},
ps AS (SELECT suffix, (k + m * mu) / (n + m) AS p FROM suffixes, ss), pd AS (SELECT domain, (k + m * ps.p) / (n + m) AS p FROM domains JOIN ps USING (suffix), sd),
ph AS (SELECT host, least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, (k + m * pd.p) / (n + m))) AS mean, n + m AS strength FROM hosts JOIN pd USING (domain), sh),
q AS (SELECT host, mean * strength AS a, (1 - mean) * strength AS b, (x + 0.5::DOUBLE) / 20000 AS t FROM ph, range(20000) r(x) WHERE mean > {MAX_BAD}),
f AS (SELECT host, t, (a - 1) * ln(t) + (b - 1) * ln(1 - t) + lgamma(a + b) - lgamma(a) - lgamma(b) AS log FROM q),
tail AS (SELECT host, sum(exp(log)) FILTER (WHERE t <= {MAX_BAD}) / sum(exp(log)) AS tail FROM f GROUP BY host),
fit AS (SELECT rid, r.host || r.path AS rule, verdict FROM u JOIN (VALUES {_RULE_ROWS}) r(host, path, verdict) ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, verdict <> 'block') = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND tail < {ALPHA} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 9) AS bad_rate
FROM u LEFT JOIN fit USING (rid) LEFT JOIN ph USING (host) LEFT JOIN tail USING (host)
"""
