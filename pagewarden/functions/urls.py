"""URL Columns: normalising, resolving, classifying and scoring.

All of them are regular expressions over one string column, so they stay inside
generated code and never fail a job on a malformed url.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions.numbers import let, lit_array

_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)"
# no upper case before the path, no fragment, no '/' at a path's end, no empty query
_NORMAL = r"^[a-z][a-z0-9+.\-]*+://[a-z0-9._:\-]++(?:/|/[^?#]*[^?#/\u0085\u2028\u2029])(?:\?[^#]++)?\z"


def strip_space(x: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _clean(url: Column) -> Column:
    return F.regexp_replace(strip_space(url), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, rf"^{_SCHEME}?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, rf"^{_SCHEME}?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(netloc(url))


def normalize_crawl_url(url: Column) -> Column:
    """Drop the fragment, lower the host, '/' for an empty path, no trailing '/'."""

    def rebuild(u: Column) -> Column:
        prefix = lambda x, p: F.when(x != "", F.concat(F.lit(p), x)).otherwise("")
        trimmed = F.regexp_replace(path(u), "/+$", "")
        return F.concat(
            F.regexp_replace(scheme(u), "(.)$", "$1:"),
            prefix(F.lower(netloc(u)), "//"),
            F.when(path(u).isin("", "/"), F.lit("/")).otherwise(trimmed),
            prefix(query(u), "?"),
        )

    # most urls are normal as they are, and one look tells
    return let(_clean(url), lambda u: F.when(u.rlike(_NORMAL), u).otherwise(rebuild(u)))


def normalize_url(url: Column) -> Column:
    """Trim and add https:// when there is no http(s) scheme; empty stays empty."""
    u = strip_space(url)
    ready = (u == "") | u.startswith("http://") | u.startswith("https://")
    return F.when(ready, u).otherwise(F.concat(F.lit("https://"), u))


def project_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(strip_space(url)), "/+$", "")


def _remove_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(p, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(
            s == "..",
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    joined = F.when(p.rlike(r"(?:^|/)\.{1,2}$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def resolve(base_scheme: Column, base_netloc: Column, base_path: Column, base_query: Column, href: Column) -> Column:
    """Resolve ``href`` against a base url that is already taken apart."""
    origin = F.concat(base_scheme, F.lit("://"), base_netloc)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    question = lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))

    def dots(p: Column) -> Column:
        return F.when(p.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), _remove_dots(p)).otherwise(p)

    def placed(tail: Column, p: Column, q: Column) -> Column:
        fragment = F.when(tail.contains("#"), F.regexp_extract(tail, r"(#.*)$", 1)).otherwise("")
        below = F.regexp_replace(F.concat(folder, p), "/{2,}", "/")
        return F.when(
            p == "",
            F.concat(origin, base_path, question(F.coalesce(F.nullif(q, F.lit("")), base_query)), fragment),
        ).otherwise(
            F.concat(origin, let(F.when(p.startswith("/"), p).otherwise(below), dots), question(q), fragment)
        )

    def relative(tail: Column) -> Column:
        # path and query are named several times: taken out once
        parts = F.struct(path(tail).alias("p"), F.when(tail.contains("?"), query(tail)).otherwise("").alias("q"))
        return F.when(
            tail.contains("//") & (netloc(tail) != ""), F.concat(base_scheme, F.lit(":"), tail)
        ).otherwise(let(parts, lambda x: placed(tail, x["p"], x["q"])))

    def choose(h: Column, given: Column) -> Column:
        tail = F.when(given != "", F.regexp_replace(h, rf"^{_SCHEME}", "")).otherwise(h)
        return F.when((given != "") & (given != base_scheme), h).otherwise(let(tail, relative))

    return let(_clean(href), lambda h: let(scheme(h), lambda given: choose(h, given)))


def resolve_url(base: Column, href: Column) -> Column:
    return let(_clean(base), lambda b: resolve(scheme(b), netloc(b), path(b), query(b), href))


def same_domain(base_host: Column, candidate_url: Column) -> Column:
    base = F.lower(base_host)
    return let(
        host(candidate_url),
        lambda cand: (cand == base)
        | cand.endswith(F.concat(F.lit("."), base))
        | base.endswith(F.concat(F.lit("."), cand)),
    )


def is_skipped(url: Column) -> Column:
    """Not a page: another scheme, or a path with a media or asset extension."""
    extensions = r"\.(?:" + "|".join(C.SKIP_EXTENSIONS) + ")$"
    return scheme(url).isin(C.SKIP_SCHEMES) | F.lower(path(url)).rlike(extensions)


def is_valid_url(url: Column) -> Column:
    """http(s) url whose host is localhost, an address or a dotted name."""
    authority = r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)"
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    full = r"\[(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\]"
    short = (
        r"\[(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:\])(?=.*::)(?!(?:.*[0-9a-f]+(?::|\])){8})"
        r"(?:[0-9a-f]{0,4}:){2,8}[0-9a-f]{0,4}\]"
    )
    host_ok = (
        rf"^(?:localhost|{octet}(?:\.{octet}){{3}}|{full}|{short}"
        rf"|(?:{label}\.)+(?!\d+\.*$){label}\.*)$"
    )
    return F.lower(F.regexp_extract(normalize_url(url), authority, 1)).rlike(host_ok)


def page_type(url: Column, rules: list[tuple[str, list[str]]] = C.PAGE_TYPES) -> Column:
    p = F.regexp_replace(F.lower(path(url)), "^/+|/+$", "")
    out = F.when(p == "", "Homepage")
    for name, words in rules:
        out = out.when(p.rlike("|".join(words)), name)
    return out.otherwise("Other")


def url_structure(url: Column) -> Column:
    """Score of a url's form as a struct; every deduction leaves an issue."""
    p, q = path(url), query(url)
    length = F.length(url)
    inner = F.regexp_replace(p, "^/+|/+$", "")
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    long_path = (F.length(inner) > 20) & ~p.contains("-")
    checks = [
        (length > 115, 15, "too_long", "Shorten the url to fewer than 75 characters."),
        ((length > 75) & (length <= 115), 5, "long", "Aim for fewer than 75 characters."),
        (q != "", 15, "query", "Prefer a static path over query parameters."),
        (p.rlike(r"\p{Lu}"), 10, "uppercase", "Use lower case in paths."),
        (p.contains("_"), 5, "underscore", "Separate words with hyphens."),
        (~p.contains("_") & long_path, 5, "unseparated", "Separate words with hyphens."),
        (p.rlike(r"[^a-zA-Z0-9\-/.%]"), 10, "special", "Remove or encode special characters."),
        (depth > 5, 5, "deep", "Keep paths to a few levels."),
    ]
    score = F.lit(100)
    for condition, points, _, _ in checks:
        score = score - F.when(condition, points).otherwise(0)
    score = F.greatest(score, F.lit(0))
    return F.struct(
        score.alias("score"),
        (score >= 70).alias("is_seo_friendly"),
        depth.alias("depth"),
        F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, _, code, _ in checks])).alias("issues"),
        F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, _, _, text in checks])).alias(
            "recommendations"
        ),
    )


def _rule_path(url: Column) -> Column:
    return F.regexp_replace(F.lower(path(url)), "/+$", "")


def sitemap_priority(url: Column) -> Column:
    p = _rule_path(url)
    out = F.when(p == "", "1.00")
    for pattern, value in C.SITEMAP_PRIORITIES:
        out = out.when(p.rlike(pattern), value)
    return out.otherwise("0.50")


def sitemap_changefreq(url: Column) -> Column:
    p = _rule_path(url)
    out = F.when(p == "", "daily")
    for pattern, value in C.SITEMAP_FREQUENCIES:
        out = out.when(p.rlike(pattern), value)
    return out.otherwise("monthly")


def registrable_label(url: Column) -> Column:
    """The label people know a site by: second from the right, third below a compound suffix."""
    labels = F.filter(
        F.split(F.element_at(F.split(host(url), ":"), 1), r"\."),
        lambda s: (s != "") & (s != "www"),
    )

    def pick(a: Column) -> Column:
        last, second, third = (F.try_element_at(a, F.lit(-i)) for i in (1, 2, 3))
        compound = (F.length(last) == 2) & second.isin(C.COMPOUND_SECOND_LEVELS)
        return F.coalesce(F.when(compound, third), second, last, F.lit(C.DEFAULT_COMPANY))

    return let(labels, pick)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, the rest in lower case."""
    pieces = F.split(F.lower(text), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def title_parts(title: Column) -> Column:
    parts = F.split(F.coalesce(title, F.lit("")), C.TITLE_SEPARATOR)
    return F.filter(F.transform(parts, strip_space), lambda s: s != "")


def company_name(url: Column, title: Column) -> Column:
    """The title part that carries the domain label, else a short part, else the label."""
    squeezed = lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")
    short = lambda s: F.size(F.split(s, r"(?U)\s+")) <= 6

    def choose(label: Column, parts: Column) -> Column:
        named = F.filter(parts, lambda s: (squeezed(label) != "") & F.contains(squeezed(s), squeezed(label)))
        return F.coalesce(
            F.try_element_at(named, F.lit(1)),
            F.try_element_at(F.filter(parts, short), F.lit(-1)),
            F.try_element_at(parts, F.lit(1)),
            F.nullif(title_case(F.replace(label, F.lit("-"), F.lit(" "))), F.lit("")),
            F.lit(C.DEFAULT_COMPANY),
        )

    return let(registrable_label(url), lambda label: let(title_parts(title), lambda parts: choose(label, parts)))


def path_allowed(url: Column, rules: Column) -> Column:
    """True when no rule of the array is a prefix of the url's path."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return ~F.exists(F.coalesce(rules, lit_array([])), lambda r: F.startswith(p, r))
