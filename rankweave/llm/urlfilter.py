"""URL filter with redirect equivalence, in DataFrame operations alone.

A rule (host, path) fits an address if its host is the rule's or a subdomain of it and its path
starts with the rule's; the longest rule wins.  Addresses joined by redirects or canonical links are
aliases: connected components over those edges share decisions.  An address with a rule keeps that
rule's verdict; one without is allowed if an alias is explicitly allowed, else blocked if an alias is
blocked, else allowed.

Aliases are compared without scheme and fragment, hosts without regard to the case of A-Z.  Links are
resolved against their page's address, ``.`` and ``..`` parts too; one of a scheme without ``://`` (``mailto:``)
is no alias.

Defined results: null address or one without ``://``: empty host and path, no rule, no alias, and so
allowed.  Null html has no edges.  Equal addresses get equal verdicts.  Rules of equal length that
both fit: an allowing one wins, then the one that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import connected_components
from rankweave.session import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
_CANONICAL = [rf"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*{_HREF}"""]
_REFRESH = [r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"'\s>]+)"""]


def _part(url: Column, pattern: str) -> Column:
    """What the pattern's group holds after the first ``://``; empty for null or without one."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://" + pattern, 1), F.lit(""))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z in lower case."""
    return F.translate(_part(url, "([^/?#]*)"), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return _part(url, "[^/?#]*([^?#]*)")


def alias_key(url: Column) -> Column:
    """An address without scheme and fragment; null without ``://`` or if nothing is left."""
    return F.nullif(F.concat(host(url), _part(url, "[^/?#]*([^#]*)")), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The winning rule as a struct (rule, verdict), null where none fits.  One expression over all
    rules, tried from the longest on, for lists of hundreds."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    fits = [F.when(((host_ == h) | host_.endswith("." + h)) & path_.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for h, p, verdict in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule: string, verdict: string>"))


def _without_dots(path_: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` parts."""
    parts = F.slice(F.split(path_, "/"), F.lit(2), F.greatest(F.size(F.split(path_, "/")) - 1, F.lit(0)))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.array_append(done, x)),
    )
    is_folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.concat_ws("/", kept), F.when(is_folder & (F.size(kept) > 0), "/").otherwise(""))


def _resolved(links: DataFrame) -> DataFrame:
    """(source, target): each link's address, relative to its page's, as RFC 3986 resolves it."""
    source, link = F.col("source"), F.col("link")
    folder = F.regexp_replace(path(source), r"[^/]*$", "")
    parts = links.withColumns({"scheme": F.regexp_extract(source, r"^[^:/?#]+", 0), "origin": host(source), "folder": F.when(folder == "", "/").otherwise(folder)})
    own_path, own_query = path(source), F.regexp_extract(source, r"(?s)://[^/?#]*[^?#]*(\?[^#]*)", 1)
    merged = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(own_path, link)).when(link.startswith("#"), F.concat(own_path, own_query)).otherwise(F.concat("folder", link))
    whole = F.when(link.startswith("//"), F.concat(F.col("scheme"), F.lit(":"), link)).when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:"), link).otherwise(F.concat("scheme", F.lit("://"), "origin", merged))
    parts = parts.select("source", whole.alias("whole"))
    whole = F.col("whole")
    head, rest = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    dotted = path(whole).rlike(r"(?s)/\.\.?(/|$)")
    return parts.select("source", F.when(dotted, F.concat(head, _without_dots(path(whole)), rest)).otherwise(whole).alias("target"))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses of canonical links and refresh redirects in pages."""
    source, text = F.col(url), F.col(html)
    likely = (F.instr(F.lower(text), "canonical") > 0) | (F.instr(F.lower(text), "refresh") > 0)
    found = pages.where(source.isNotNull() & likely).select(
        source.alias("source"), F.explode(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in (*_CANONICAL, *_REFRESH)])).alias("link")
    )
    found = cut(found.where("link <> ''"))  # few pages have any
    return _resolved(found.withColumn("link", F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    ``edges`` (source, target) are addresses; decisions of addresses that no page has count too.
    """
    base = pages.drop("host", "path", "rule", "verdict")
    address = F.col(url)
    own = base.withColumns({"host": host(address), "path": path(address)}).withColumn("_won", rule_of(F.col("host"), F.col("path"), rules))
    edges = cut(edges.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    ruled = F.col("_won.verdict")
    if edges.isEmpty():
        verdict = F.coalesce(ruled, F.lit("allow"))
    else:
        groups = connected_components(edges)
        key = F.concat(F.lit("x://"), F.col("node"))
        won = rule_of(host(key), path(key), rules)["verdict"]
        decided = groups.select("component", won.alias("won")).groupBy("component").agg(F.max((F.col("won") == "allow").cast("int")).alias("allowed"), F.max((F.col("won") == "block").cast("int")).alias("blocked"))
        aliases = groups.join(decided, "component").where("blocked = 1 and coalesce(allowed, 0) = 0").select(F.col("node").alias("_key"), F.lit("block").alias("_shared"))
        own = own.withColumn("_key", alias_key(address)).join(aliases, "_key", "left")
        verdict = F.coalesce(ruled, F.col("_shared"), F.lit("allow"))
    return own.select(*base.columns, "host", "path", F.col("_won.rule").alias("rule"), verdict.alias("verdict"))
