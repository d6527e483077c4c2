"""URL filter: Empirical-Bayes reputation of hosts, under a short list of rules that take precedence.

Labelled page outcomes (bad or not) are counted per host, and shrunk through beta-binomial priors: all pages, public
suffix, registered domain, host.  Each level's prior strength comes from the spread of its groups by the method of
moments.  A host is blocked if the lower bound of its posterior bad rate is over ``cut``.

Only counts per host are shuffled, summed before that.  Verdicts go back to pages by a join in which the pages of a host
with a large share of all are dealt over as many keys as that share needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import cut as cut_lineage
from marlstone.llm.cluster import dealt

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; any other host's suffix is its last label.
#: A list of all that a crawl may meet is a parameter of the caller's; these are frequent ones.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-cased (A-Z) host after the first ``://``, and the path after it; both empty for null or another form."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, whose port is left out; an IPv4 address is its own suffix and domain."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    wide, number = two.isin(*TWO_LABEL_SUFFIXES), name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(number, name).when(wide, two).otherwise(F.substring_index(name, ".", -1)), F.when(number, name).when(wide, three).otherwise(two)


def page_outcome(html: str = "html") -> Column:
    """1 if over one in a hundred of the page's characters is one of ``#*$%``, which marks pages of symbol junk."""
    text = F.coalesce(F.col(html), F.lit(""))
    return (100 * F.regexp_count(text, F.lit("[#*$%]")) > F.length(text)).cast("int")


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength a + b of groups (k bad of n) around their prior means, from the moments of the beta-binomial.

    It is 2 at least, so that a single page never decides, and 999 at most.
    """
    m = F.col(mean)
    spread = F.when(m * (1 - m) > 0, F.col("n") * (F.col("k") / F.col("n") - m) ** 2 / (m * (1 - m)))
    s, g, n = groups.where("n > 0").agg(F.sum(spread), F.count("*"), F.sum("n")).first()
    rho = (s - g) / (n - g) if s is not None and n > g else 0.001
    return 1 / min(max(rho, 0.001), 1 / 3) - 1


def reputation(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """counts: host, n (labelled pages), k (bad ones); adds the posterior a, b and the lower bound of the bad rate.

    A host without a labelled page has its domain's prior.  With no labelled page at all the mean is one half.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = cut_lineage(counts.withColumn("suffix", suffix).withColumn("domain", domain))
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    level = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = level.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(k / n if n else 0.5))
    s = _strength(top, "prior")
    top = top.select("suffix", ((F.col("prior") * s + F.col("k")) / (s + F.col("n"))).alias("prior"))
    level = level.join(top, "suffix")
    s = _strength(level, "prior")
    level = level.select("suffix", "domain", ((F.col("prior") * s + F.col("k")) / (s + F.col("n"))).alias("prior"))
    hosts = hosts.join(level, ["suffix", "domain"])
    s = _strength(hosts, "prior")
    a, b = F.col("prior") * s + F.col("k"), (1 - F.col("prior")) * s + F.col("n") - F.col("k")
    hosts = hosts.withColumn("a", a).withColumn("b", b)
    mean, sd = F.expr("a / (a + b)"), F.expr("sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))")
    return hosts.withColumn("bound", mean - z * sd)


def judge_urls(pages: DataFrame, outcome: Column | None = None, rules: tuple[Rule, ...] = RULES, cut: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages, repeated rows included.

    pages: page_id, url, and what outcome reads (1 bad, 0 good, null not labelled; by default the html).  A null url or
    one without ``://`` has an empty host, whose pages count as one host.  Other columns are ignored, whatever their names;
    urls and pages may be of any length.  An empty table gives no rows.
    """
    outcome = page_outcome() if outcome is None else outcome
    host, path = host_and_path()
    counts = pages.select(host.alias("host"), outcome.alias("bad")).groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"), F.count("*").alias("n_rows"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows, blocked = dealt(rows, reputation(counts, z).select("host", (F.col("bound") > cut).alias("blocked"), "n_rows"), "host", ["page_id", "path"])
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.join(blocked, ["host", "salt"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
