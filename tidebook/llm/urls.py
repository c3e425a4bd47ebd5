"""URL filters with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule decides.
Pages without a rule of their own are judged by their aliases: redirects (``meta refresh``) and canonical links are
edges between addresses, and the connected components of these edges are aliases of each other.  A component with a
blocked address blocks its undecided members, unless a rule explicitly allows an address in it: an explicit allow
takes precedence.  Without either, a page is allowed.

Of fitting rules of one length an allow wins, then the smallest by action, host and path.

An address is scheme-less: host in lower case, path (``/`` if empty, dot segments resolved) and query, no fragment.
All canonical and refresh tags of a page are edges.

Defined cases: a null url, or one without ``://``, has an empty host and path, no address and so no aliases; null
html has no edges; repeated pages are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.components import connected_components

Rule = tuple[str, str, str]

#: The contract's rules: action, host, path prefix.
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rule lists up to this length are one expression; longer ones are joined on the suffixes of hosts.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Tags that name an alias, and where in the tag it stands; the same in Spark's and DuckDB's expressions.
_TAGS = (
    (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"),
)
_DOTS = r"/\.\.?(/|$)"


def _part(url: Column, number: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, number), F.lit(""))


def host_of(url: Column) -> Column:
    """The host, A-Z in lower case; empty without one."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path up to query and fragment; empty without one."""
    return _part(url, 2)


def _plain_path(path: Column) -> Column:
    """The path of an address: ``/`` for an empty one, without dot segments."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))

    joined = F.aggregate(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), F.lit(""), step)
    resolved = F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path == "", "/").when(path.rlike(_DOTS), resolved).otherwise(path)


def address_of(url: Column) -> Column:
    """Host, path and query; null for a url without ``://``."""
    return F.when(url.contains("://"), F.concat(host_of(url), _plain_path(path_of(url)), _part(url, 3)))


def _ranked(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...], host: str, path: str) -> DataFrame:
    """Add columns ``rule`` and ``action`` of the longest fitting rule; both null without one."""
    if len(rules) <= INLINE_RULES:
        best = F.lit(None).cast("struct<rule:string,action:string>")
        for action, h, p in reversed(_ranked(rules)):
            fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
            best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
        return pages.withColumn("best_rule_", best).select(*pages.columns, "best_rule_.rule", "best_rule_.action")
    spark = pages.sparkSession
    listed = spark.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "h string, p string, rule string, action string")
    places = pages.select(host, path).distinct()
    labels = F.split(host, r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fitting = places.select(host, path, suffix.alias("h")).join(listed, "h").where(F.col(path).startswith(F.col("p")))
    order = F.struct((-F.length("rule")).alias("n"), (F.col("action") != "allow").alias("blocks"), "action", "h", "p", "rule")
    chosen = fitting.groupBy(host, path).agg(F.min(order).alias("o")).select(host, path, "o.rule", "o.action")
    return pages.join(chosen, [host, path], "left")


def edges_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (page, target) of redirects and canonical links; relative targets are resolved against the page."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")

    def named_by(tag: str, at: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, at, 1))

    tags = F.concat(*[named_by(*pair) for pair in _TAGS])
    raw = pages.where(url.contains("://") & html.rlike("(?i)canonical|refresh")).select(url.alias("url"), F.explode(tags).alias("to"))
    target = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    whole = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(F.lit("x://"), host, target))
        .when(target.startswith("?"), F.concat(F.lit("x://"), host, path, target))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), target))
    )
    named = raw.where("to != '' AND NOT startswith(to, '#')")
    return named.select(address_of(F.col("url")).alias("page"), address_of(whole).alias("target"))


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    url_col: str = "url",
    html_col: str = "html",
    id_col: str = "page_id",
    extra_edges: DataFrame | None = None,
) -> DataFrame:
    """Verdict of every page: id, host, path, rule, verdict and whether an alias decided it.

    ``extra_edges`` may bring further pairs of urls known to be aliases, such as a crawler's redirect log.
    """
    url = F.col(f"`{url_col}`")
    edges = edges_of(pages, url_col, html_col)
    if extra_edges is not None:
        a, b = (address_of(F.col(f"`{c}`")) for c in extra_edges.columns)
        edges = edges.unionByName(extra_edges.select(a.alias("page"), b.alias("target")))
    groups = connected_components(edges.where("page IS NOT NULL AND target IS NOT NULL"))
    fake = F.concat(F.lit("x://"), F.col("node"))
    placed = with_rule(groups.withColumn("host", host_of(fake)).withColumn("path", path_of(fake)), rules, "host", "path")
    decided = placed.groupBy("component").agg(
        F.bool_or(F.col("action") == "block").alias("blocked"), F.bool_or(F.col("action") == "allow").alias("allowed")
    )
    blocked = decided.where(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).select("component")
    aliases = groups.join(blocked, "component").select(F.col("node").alias("address"), F.lit(True).alias("alias_blocked"))

    own = with_rule(
        pages.select(
            F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")
        ),
        rules,
        "host",
        "path",
    )
    if aliases.isEmpty():
        own = own.withColumn("alias_blocked", F.lit(False))
    else:  # only undecided pages with an address can follow an alias
        open_ = F.col("rule").isNull() & F.col("address").isNotNull()
        own = (
            own.where(open_)
            .join(aliases, "address", "left")
            .unionByName(own.where(~open_).withColumn("alias_blocked", F.lit(None).cast("boolean")))
        )
    by_alias = F.coalesce(F.col("alias_blocked"), F.lit(False)) & F.col("rule").isNull()
    return own.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        by_alias.alias("by_alias"),
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages."""
    return judge(table(spark, sf_dir, "pages")).drop("by_alias")


def _sql_rule(url: str) -> str:
    """A struct of the best rule for DuckDB columns host and path."""
    cases = " ".join(
        f"WHEN (h = '{h}' OR ends_with(h, '.{h}')) AND starts_with(p, '{p}') THEN {{'rule': '{h + p}', 'action': '{a}'}}" for a, h, p in _ranked(RULES)
    )
    return cases


_SQL_LOWER = f"translate({{}}, '{_UPPER}', '{_LOWER}')"


def _sql_part(url: str, number: int) -> str:
    part = f"regexp_extract({url}, '{_PARTS}', {number})"
    return _SQL_LOWER.format(part) if number == 1 else part


def _sql_address(url: str) -> str:
    path = _sql_part(url, 2)
    joined = (
        f"list_reduce(string_split(substr({path}, 2), '/'), lambda done, part: CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') "
        f"WHEN part = '.' THEN done ELSE done || '/' || part END, '')"
    )
    plain = f"CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, '{_DOTS}') THEN {joined} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {path} END"
    return f"CASE WHEN contains({url}, '://') THEN {_sql_part(url, 1)} || {plain} || {_sql_part(url, 3)} END"


def _sql_tags() -> str:
    quoted = [tuple(x.replace("'", "''").replace('\\"', '"') for x in pair) for pair in _TAGS]
    return " UNION ALL ".join(
        f"SELECT url, regexp_extract(tag, '{at}', 1) AS t FROM (SELECT url, unnest(regexp_extract_all(html, '{tag}')) AS tag FROM pages)" for tag, at in quoted
    )


ORACLE_SQL = rf"""
WITH RECURSIVE tags AS (
  {_sql_tags()}
), targets AS (
  SELECT url, replace(t, '&amp;', '&') AS t, {_sql_part("url", 1)} AS h, {_sql_part("url", 2)} AS p,
         regexp_replace({_sql_part("url", 2)}, '[^/]*$', '') AS f
  FROM tags WHERE t <> '' AND NOT starts_with(t, '#') AND contains(url, '://')
), whole AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN 'x://' || h || t
         WHEN starts_with(t, '?') THEN 'x://' || h || p || t
         ELSE 'x://' || h || CASE WHEN f = '' THEN '/' ELSE f END || t END AS t FROM targets
), edge AS (
  SELECT {_sql_address('url')} AS a, {_sql_address('t')} AS b FROM whole
), both_ways AS (
  SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (
  SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), alias AS (
  SELECT a, bool_or(r.action = 'block') AND NOT coalesce(bool_or(r.action = 'allow'), false) AS blocked
  FROM (SELECT a, CASE {_sql_rule('b')} END AS r
        FROM (SELECT a, b, regexp_extract('x://' || b, '{_PARTS}', 1) AS h, regexp_extract('x://' || b, '{_PARTS}', 2) AS p FROM reach))
  GROUP BY a
), page AS (
  SELECT page_id, coalesce({_sql_part("url", 1)}, '') AS h, coalesce({_sql_part("url", 2)}, '') AS p, {_sql_address('url')} AS address FROM pages
)
SELECT page_id, h AS host, p AS path, r.rule AS rule,
       coalesce(r.action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT page_id, h, p, address, CASE {_sql_rule('')} END AS r FROM page) LEFT JOIN alias ON address = a
"""
