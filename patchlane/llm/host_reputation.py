"""URL filter by host reputation: labelled page outcomes, shrunk through beta-binomial priors.

A page with a label has an outcome, good or bad. The good share of a suffix is shrunk toward that of all pages, a registered
domain's toward its suffix's, a host's toward its domain's: the parent's share is the mean of a beta prior, whose strength
is fitted at each level by the method of moments (how much more the children's counts scatter than binomial ones would), but
is no more than the parent's outcomes and two, so that few labels judge nobody. A child's own outcomes are taken out of its
parent's, so that none counts twice.
A host is blocked if even the upper bound of its good share's posterior (mean and `z` deviations) is below `least_good`; a
host without labelled pages has its domain's prior alone. Rules go before: of those that fit a url the longest one decides.

All of it is DataFrame functions. Outcomes are counted by host with partial sums; where rows meet the facts of their host,
domain or suffix, keys of more than a quarter of a shuffle partition (at most four a partition) meet them by broadcast and
stay where they are, so no host is a hot key. Three levels' strengths (a number each) come to the driver.

Defined cases: a null url, or one without "://", has an empty host and path, and such pages are one host; a null identifier
has no label; of several labels of one page the worst counts, a label without quality is none; equal rows count each; an
address of digits is its own domain and has no suffix; an empty table gives no rows; without any label the good share of
all is one half and nothing is blocked at the bounds' defaults; other columns are not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir
from .spelling import LOWER, UPPER

#: Public suffixes of two labels; all others are taken to have one.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")
#: The scatter between children (the beta-binomial correlation): bounds (a prior is worth two outcomes at least), and what is
#: taken where no child has two outcomes.
LEAST_SCATTER, MOST_SCATTER, UNKNOWN_SCATTER = 1e-4, 1 / 3, 1 / 3
Z, LEAST_GOOD = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and public suffix of a host, without user and port."""
    bare = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    tail = lambda n: F.substring_index(bare, ".", -n)
    double = tail(2).isin(*double_suffixes)
    digits = bare.rlike("^[0-9.]+$|^\\[")
    domain = F.when(digits, bare).otherwise(F.when(double, tail(3)).otherwise(tail(2)))
    return domain, F.when(digits, "").otherwise(F.when(double, tail(2)).otherwise(tail(1)))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of length, rule and verdict of the longest rule (host, path, verdict) that fits, or null; of two of one length
    the later in code-point order. Rules are looked up by the host's endings, so a url costs its labels, not all rules."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    by: dict[str, list] = {}
    for h, p, v in rules:
        by.setdefault(h, []).append(F.struct(F.lit(p).alias("path"), F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
    table = F.create_map(*[x for h, these in by.items() for x in (F.lit(h), F.array(*these))])
    labels = F.split(host, "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(endings, lambda e: F.try_element_at(table, e)), lambda r: r.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, salt: Column) -> DataFrame:
    """rows with the columns of facts, one row for each key, whose column `size` says how many rows hold it.

    Hot keys' facts are broadcast, and their rows get a filler in place of the key in the other join."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) > whole / (4 * parts)
    names = [c for c in facts.columns if c not in (key, size)]
    near = facts.where(hot).select(key, F.struct(*names).alias("__hot"))
    far = facts.where(~hot).select(key, F.lit(0).alias("__fill"), F.struct(*names).alias("__cold"))
    met = rows.join(F.broadcast(near), key, "left")
    met = met.withColumn("__fill", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(salt, F.lit(4096)).cast("int"))).join(far, [key, "__fill"], "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in names])


def outcomes(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """host, domain, suffix, pages, n (pages with an outcome) and good of every host.

    labels: the page's identifier, quality (1 good) and, if there is one, toxic (1 bad)."""
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good = good & (F.coalesce("toxic", F.lit(0)) != 1)
    known = labels.where(F.col("quality").isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.min(good.cast("long")).alias("good"))
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id"), host.alias("host")).groupBy("__id", "host").agg(F.count("*").alias("pages"))
    counted = rows.join(known, "__id", "left").groupBy("host").agg(
        F.sum("pages").alias("pages"), F.coalesce(F.sum(F.when(F.col("good").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("pages") * F.col("good")), F.lit(0)).alias("good")
    )
    domain, suffix = domain_and_suffix(F.col("host"))
    return counted.withColumns({"domain": domain, "suffix": suffix})


def strength(children: DataFrame, mean: str) -> float:
    """The strength of the prior (as a number of outcomes) that the children's n and good ask for, around their parents' mean."""
    m, n = F.col(mean), F.col("n")
    over = F.sum(F.pow(F.col("good") - n * m, 2) - n * m * (1 - m)) / F.nullif(F.sum(n * (n - 1) * m * (1 - m)), F.lit(0.0))
    scatter = children.agg(over.alias("s")).first()["s"]
    scatter = UNKNOWN_SCATTER if scatter is None else min(max(scatter, LEAST_SCATTER), MOST_SCATTER)
    return (1 - scatter) / scatter


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, pages, n, good and good_bound (the upper bound of the good share) of the hosts that outcomes counted; a table
    that is read several times."""
    folder = shared_dir(hosts.sparkSession)
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("hosts")), "domains", folder)
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("domains")), "suffixes", folder)
    n, good = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()

    def prior(children: DataFrame) -> DataFrame:
        """The parent's share and outcomes without the child's own."""
        return children.withColumns({"parent": (F.col("above_good") - F.col("good")) / (F.col("above_n") - F.col("n")), "outcomes": F.col("above_outcomes") - F.col("n")}).drop("above_good", "above_n", "above_outcomes")

    def worth(children: DataFrame) -> Column:
        return F.least(F.lit(strength(children, "parent")), F.col("outcomes") + 2.0)

    def shrunk(children: DataFrame, key: str, size: str) -> DataFrame:
        s = worth(children)
        return children.select(key, size, (s * F.col("parent") + F.col("good")).alias("above_good"), (s + F.col("n")).alias("above_n"), F.col("n").alias("above_outcomes"))

    top = prior(suffixes.withColumns({"above_good": F.lit(good + 1.0), "above_n": F.lit(n + 2.0), "above_outcomes": F.lit(n)}))
    below = prior(with_facts(domains, shrunk(top, "suffix", "domains"), "suffix", "domains", F.xxhash64("domain")))
    own = prior(with_facts(hosts, shrunk(below, "domain", "hosts"), "domain", "hosts", F.xxhash64("host")))
    own = materialize(own, "hosts-by-domain", folder)
    s = worth(own)
    a, b = s * F.col("parent") + F.col("good"), s * (1 - F.col("parent")) + F.col("n") - F.col("good")
    bound = a / (a + b) + z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return own.select("host", "pages", "n", "good", bound.alias("good_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = (), z: float = Z, least_good: float = LEAST_GOOD, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """The id column, host, path, rule (null if none fits), verdict (allow or block), and the host's n_labelled, n_good and
    good_bound, of every page."""
    hosts = materialize(outcomes(pages, labels, id_col, url_col, label_id), "hosts")
    facts = reputations(hosts, z).withColumnsRenamed({"n": "n_labelled", "good": "n_good"})
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    rows = with_facts(rows, facts, "host", "pages", F.xxhash64("__id", "path"))
    rows = rows.withColumn("__rule", matched_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("good_bound") < least_good, "block").otherwise("allow")
    return rows.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "n_labelled", "n_good", "good_bound")


def _sql(rules: Sequence[tuple[str, str, str]]) -> str:
    level = lambda name, rows, key: f"""{name}_prior as (
  select (1 - r) / r as s from (select least(greatest(coalesce(sum(pow(good - n * parent, 2) - n * parent * (1 - parent)) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0), {UNKNOWN_SCATTER!r}::double), {LEAST_SCATTER}::double), {MOST_SCATTER!r}::double) as r from {rows})
), {name}_worth as (select c.*, least(s, outcomes + 2) as worth from {rows} c, {name}_prior
), {name} as (select {key}, worth * parent + good as above_good, worth + n as above_n, n as above_outcomes from {name}_worth)"""  # noqa: E731
    without = "(above_good - good) / (above_n - n) as parent, above_outcomes - n as outcomes"
    digits = "regexp_matches(bare, '^[0-9.]+$|^\\[')"
    double = f"array_to_string(labels[-2:], '.') in ({', '.join(repr(s) for s in DOUBLE_SUFFIXES)})"
    tail = lambda n: f"array_to_string(labels[-{n}:], '.')"
    return f"""
with parsed as (
  select page_id, coalesce(case when contains(url, '://') then translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') end, '') as host,
         coalesce(case when contains(url, '://') then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) end, '') as path
  from (select page_id, url, substr(url, instr(url, '://') + 3) as rest from pages)
), known as (select doc_id, min((quality = 1 and coalesce(toxic, 0) <> 1)::int) as good from labels where quality is not null group by doc_id
), counted as (select host, count(good) as n, coalesce(sum(good), 0) as good from parsed left join known on page_id = doc_id group by host
), bare as (select *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') as bare from counted
), labelled as (select *, string_split(bare, '.') as labels from bare
), hosts as (
  select host, n, good, case when {digits} then bare when {double} then {tail(3)} else {tail(2)} end as domain, case when {digits} then '' when {double} then {tail(2)} else {tail(1)} end as suffix from labelled
), domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by all
), whole as (select coalesce(sum(good), 0) + 1.0::double as above_good, coalesce(sum(n), 0) + 2.0::double as above_n, coalesce(sum(n), 0) as above_outcomes from hosts
), suffixes as (select c.*, {without} from (select suffix, sum(n) as n, sum(good) as good from domains group by suffix) c, whole
), {level("by_suffix", "suffixes", "suffix")},
below as (select c.*, {without} from domains c join by_suffix using (suffix)),
{level("by_domain", "below", "domain")},
own as (select c.*, {without} from hosts c join by_domain using (domain)),
{level("by_host", "own", "host")},
beta as (select host, n, good, worth * parent + good as a, worth * (1 - parent) + n - good as b from by_host_worth),
bounds as (select host, n, good, a / (a + b) + {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) as good_bound from beta),
rules(rule_host, rule_path, ruled) as (values {', '.join(repr(r) for r in rules)}),
fits as (
  select host, path, max({{'length': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': ruled}}) as best
  from (select distinct host, path from parsed) join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by host, path
)
select page_id, p.host, p.path, best.rule as rule, coalesce(best.verdict, case when good_bound < {LEAST_GOOD} then 'block' else 'allow' end) as verdict,
       n::bigint as n_labelled, good::bigint as n_good, round(good_bound, 6) as good_bound
from parsed p join bounds b on p.host = b.host left join fits f on p.host = f.host and p.path = f.path
"""


#: Rules of the registered query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SQL = _sql(RULES)
