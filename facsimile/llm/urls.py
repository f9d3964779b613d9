"""URL filters with redirect equivalence.

Rules judge a url by host suffix and path prefix.  Redirects (meta refresh, or a table of them) and
canonical links say that two urls are one resource: the connected components of those edges share a
judgement.  A url's own rule always decides.  A url without a rule is blocked when its component holds
a blocked url and no explicitly allowed one; otherwise it is allowed.

Only DataFrame expressions are used.  The rule list is an argument of the job (one literal array in the
plan, at most ``MAX_RULES`` of them, else an error); urls, edges and components stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ascii_lower, free_name, stored
from facsimile.llm.components import components

MAX_RULES = 4096


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The resource a url names: host, path and query; scheme and fragment do not count.  Null if it has no host."""
    rest = F.regexp_extract(_rest(url), r"^[^#]*", 0)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest))))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), or null.  Equal lengths: the later text, then block."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are taken as one list")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    listed = F.array(*[
        F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"),
                 F.lit(r.host).alias("host"), F.lit(r.path).alias("path"))
        for r in rules
    ])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(host != "", best)


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])


def _resolved(target: Column, url: Column) -> Column:
    """An absolute url for the value of a link on the page ``url``."""
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*", 0)
    base = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)?", 0)
    return (
        F.when(t == "", None)
        .when(F.contains(t, F.lit("://")), t)
        .when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(base, t))
        .when(F.startswith(t, F.lit("?")), F.concat(base, path_of(url), t))
        .when(F.startswith(t, F.lit("#")), url)
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), t))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a_url, b_url): the canonical link and the meta refresh of each page, resolved; pages without one give no row."""
    u, h = F.col(url), F.col(html)
    canonical = F.regexp_extract(h, r"""(?is)<link\s(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*>""", 0)
    refresh = F.regexp_extract(h, r"""(?is)<meta\s(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>""", 0)
    moved = F.regexp_extract(_attribute(refresh, "content"), r"""(?is)\burl\s*=\s*['"]?([^'"]+)""", 1)
    found = F.array(_resolved(F.when(F.col("_canonical") != "", _attribute(F.col("_canonical"), "href")), u), _resolved(F.col("_moved"), u))
    tagged = (
        pages.where(u.isNotNull() & h.rlike("(?i)canonical|http-equiv"))
        .select(u.alias(url), canonical.alias("_canonical"), moved.alias("_moved"))
    )
    return tagged.select(F.col(url).alias("a_url"), F.explode(found).alias("b_url")).where(F.col("b_url").isNotNull())


def inherited(links: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(node, verdict) for every node of ``links`` (a_url, b_url): block if its component has a blocked and no allowed url."""
    ends = [
        F.struct(node_of(F.col(c)).alias("node"), fitting_rule(host_of(F.col(c)), path_of(F.col(c)), rules)["verdict"].alias("own")).alias(c[0])
        for c in ("a_url", "b_url")
    ]
    sides = stored(links.select(*ends).where(F.col("a.node").isNotNull() & F.col("b.node").isNotNull()), "links")
    member = components(sides.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    own = sides.select("a.*").unionByName(sides.select("b.*")).groupBy("node").agg(F.max("own").alias("own"))
    flags = (
        member.join(own, "node").groupBy("component")
        .agg(F.bool_or(F.col("own") == "block").alias("blocked"), F.bool_or(F.col("own") == "allow").alias("allowed"))
        .select("component", F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("verdict"))
    )
    return member.join(flags, "component").select("node", "verdict")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict.

    ``redirects`` (a_url, b_url) adds edges known from elsewhere.  A null url, or one without ``://``, has
    empty host and path, fits no rule and is allowed.  Null html has no links.  Repeated urls get equal
    verdicts, columns of the input with these names are replaced, other columns stay.
    """
    rule, key, alias = (free_name(pages, c) for c in ("_rule", "_key", "_alias"))
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("a_url", "b_url"))
    shared = stored(inherited(links, rules).where(F.col("verdict") == "block").select(F.col("node").alias(key), F.lit(True).alias(alias)).distinct(), "aliases")
    u = F.col(url)
    judged = (
        pages.withColumns({"host": host_of(u), "path": path_of(u)})
        .withColumns({rule: fitting_rule(F.col("host"), F.col("path"), rules),
                      key: F.coalesce(node_of(u), F.concat(F.lit("#"), F.xxhash64(*pages.columns).cast("string")))})
        .join(shared, key, "left")
    )
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(alias), "block").otherwise("allow"))
    return judged.withColumns({"rule": F.col(f"{rule}.rule"), "verdict": verdict}).drop(rule, key, alias)
