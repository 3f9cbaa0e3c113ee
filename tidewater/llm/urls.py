"""URL filter: fixed rules first, else the host's reputation by empirical Bayes.

Labelled outcomes of pages are counted per host, registered domain and suffix. Each
level's bad rate is shrunk towards its parent's by a beta prior whose strength is
estimated from how far the level's rates spread around their parents' (beta-binomial
moments). A host is blocked if the lower bound of its posterior bad rate is above the
tolerance, so hosts with little evidence stand with their domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk sch.uk ac.jp co.jp go.jp ne.jp or.jp com.au edu.au gov.au id.au net.au org.au ac.nz co.nz govt.nz net.nz org.nz co.za org.za com.br gov.br net.br org.br com.cn edu.cn gov.cn net.cn org.cn ac.in co.in gov.in net.in org.in ac.kr co.kr go.kr or.kr com.mx org.mx com.tr org.tr com.tw org.tw com.hk com.sg com.ar co.il co.id"
).split()
#: A host whose bad rate is above the tolerance with this many standard deviations is blocked.
TOLERANCE, DEVIATIONS = 0.3, 1.645
#: The bad rate that one unlabelled page's worth of evidence stands for.
USUAL_RATE = 0.1
#: Bounds of the spread, and the spread where no group has two outcomes.
LEAST_SPREAD, MOST_SPREAD, USUAL_SPREAD = 0.001, 0.5, 0.01


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if none."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no host."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def _name(host_col: Column) -> Column:
    """The host without user, port and a final dot."""
    return F.regexp_replace(F.regexp_replace(host_col, r"^.*@|:[0-9]*$", ""), r"\.$", "")


def suffix(host_col: Column) -> Column:
    """The public suffix; an address in numbers has the suffix `ip`."""
    name = _name(host_col)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$|[\[\]]"), "ip").when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host_col: Column) -> Column:
    """The suffix and the label before it; the host itself where there is none."""
    name, end = _name(host_col), suffix(host_col)
    longer = F.when(end.contains("."), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(end == "ip", name).otherwise(longer)


def matching_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent of it and the path's start, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, begin = rule.partition("/")
        fits = ((host_col == name) | host_col.endswith(f".{name}")) & path_col.startswith(slash + begin)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _spread(level: DataFrame) -> float:
    """How much the rates of a level (n, bad, parent's mean) spread beyond chance."""
    gap = F.col("bad") / F.col("n") - F.col("prior")
    sums = level.where("n > 0").agg(F.sum(F.col("n") * gap * gap / (F.col("prior") * (1 - F.col("prior")))), F.count("*"), F.sum("n")).first()
    if not sums[1] or sums[2] == sums[1]:
        return USUAL_SPREAD
    return min(MOST_SPREAD, max(LEAST_SPREAD, (sums[0] - sums[1]) / (sums[2] - sums[1])))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Posterior of every host: (host, labelled, bad, mean, lower).

    outcomes: (host, bad boolean or null), one row per page; null means not labelled.
    Without any labelled page every mean is the usual rate, so no host is blocked.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
    hosts = stored(hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (total[1] + USUAL_RATE) / (total[0] + 1)
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(overall))
    shrunk = lambda strength: (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)
    for key, finer in (("suffix", ["suffix", "domain"]), ("domain", None)):
        spread = _spread(level)
        above = level.select(key, shrunk((1 - spread) / spread).alias("prior"))
        below = hosts.groupBy(*finer).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) if finer else hosts
        level = below.join(above, key)
    spread = _spread(level)
    strength = (1 - spread) / spread
    mean = shrunk(strength)
    lower = mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))
    return level.select("host", F.col("n").alias("labelled"), "bad", mean.alias("mean"), lower.alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], tolerance: float = TOLERANCE) -> DataFrame:
    """Verdict on every page: the longest fitting rule's, else its host's reputation.

    pages: page_id, url; outcomes: page_id, bad. Pages without an outcome, null and
    malformed urls (empty host and path) get a verdict too; equal urls get the same.
    Several outcomes of one page count as one, bad if any is. Returns page_id, host,
    path, rule, verdict and the host's labelled and bad counts.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("_bad"))
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    seen = reputations(parsed.join(known, "page_id", "left").select("host", F.col("_bad").alias("bad")))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    said = F.lit(None).cast("string")
    for name, verdict in rules:
        said = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(said)
    own = F.when(F.col("lower") > tolerance, F.lit("block")).otherwise(F.lit("allow"))
    joined = parsed.join(seen, "host", "left").withColumn("rule", rule)
    return joined.select("page_id", "host", "path", "rule", F.coalesce(said, own).alias("verdict"), "labelled", "bad")
