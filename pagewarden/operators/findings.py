"""Rules that judge one page. Every rule is a struct Column built from the page's row.

``page_audit`` keeps all nine findings inside the row, so module scores, the weighted
score, the breakdown and the key issue are column arithmetic without a shuffle.
``findings`` explodes the array once when the long form is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions import numbers as N
from pagewarden.operators.rows import unnest


def _finding(
    pos: int, module: str, category: str, metric: str, label: str, score: Column, priority: Column,
    value: Column, impact: Column, advice: Column, observation: Column,
) -> Column:
    """``score`` is within 0-100 already."""
    return F.struct(
        F.lit(pos).alias("metric_pos"),
        F.lit(module).alias("module"),
        F.lit(category).alias("category"),
        F.lit(metric).alias("metric"),
        value.alias("current_value"),
        F.lit(f"{C.BENCHMARK_YEAR} standard: {label}.").alias("benchmark"),
        score.alias("score"),
        N.status_from_score(score).alias("status"),
        priority.alias("priority"),
        impact.alias("business_impact"),
        advice.alias("recommendation"),
        observation.alias("observation"),
    )


def _text(*parts: Column | str) -> Column:
    pattern = "".join(p.replace("%", "%%") if isinstance(p, str) else "%s" for p in parts)
    return F.format_string(pattern, *[p.cast("string") for p in parts if not isinstance(p, str)])


def _length_score(n: Column, raw: Column, bad: int, penalty: int) -> Column:
    return F.when(n == 0, 0.0).when(raw < bad, F.greatest(F.lit(0.0), raw - penalty)).otherwise(raw)


def _length_rule(
    pos: int, metric: str, noun: str, key: str, n: Column, low: int, high: int, bad: int,
    raw: Column, score: Column,
) -> Column:
    """Title and description share one shape: how far a length is from its range."""
    priority = F.when((n == 0) | (raw < bad), "High").when(raw < 90, "Medium").otherwise("Low")
    case = lambda none, fit, short, long: (
        F.when(n == 0, none).when(n.between(low, high), fit).when(n < low, short).otherwise(long)
    )
    return _finding(
        pos, "metadata", "Metadata", metric, C.BENCHMARK_LABELS[key], score, priority,
        F.when(n == 0, f"No {noun} found.").otherwise(
            _text(N.format_percentage(score), f" attainment, {noun} of ", n, " characters.")
        ),
        case(
            f"Search results show no {noun} of your own.",
            f"The {noun} fits the space search results give it.",
            f"A short {noun} leaves space in search results unused.",
            f"A long {noun} is cut off in search results.",
        ),
        case(
            f"Write a {noun} of {low} to {high} characters.",
            f"Keep the {noun} as it is.",
            f"Lengthen the {noun} to {low} to {high} characters.",
            f"Shorten the {noun} to {low} to {high} characters.",
        ),
        _text(f"{noun.capitalize()} length is ", n, "."),
    )


def _flag_rule(pos: int, module: str, metric: str, label: str, flag: Column, noun: str) -> Column:
    say = lambda yes, no: F.when(flag, yes).otherwise(no)
    return _finding(
        pos, module, "Technical", metric, label,
        F.when(flag, 100.0).otherwise(0.0), say("Low", "High"),
        say(f"The {noun} is present.", f"The {noun} is missing."),
        say(f"The {noun} does its work.", f"Without a {noun} search engines have to guess."),
        say(f"Keep the {noun}.", f"Add a {noun}."),
        say(f"{noun.capitalize()} detected.", f"{noun.capitalize()} not detected."),
    )


def heading_score(count: Column) -> Column:
    return F.when(count == 1, 100.0).when(count == 0, 0.0).otherwise(N.clamp(100.0 - (count - 1) * 30.0))


def heading_finding(count: Column, score: Column) -> Column:
    say = lambda one, none, many: F.when(count == 1, one).when(count == 0, none).otherwise(many)
    return _finding(
        4, "headings", "Headings", "Heading Structure", C.BENCHMARK_LABELS["h1"], score,
        say("Low", "High", "High"),
        say(F.lit("One H1."), F.lit("No H1."), _text(count, " H1 tags compete.")),
        say("The topic of the page is clear.", "The page states no topic.", "The topic of the page is split."),
        say("Keep the single H1.", "Add one H1.", "Keep one H1 and demote the others."),
        _text("H1 tags: ", count, "."),
    )


def authority_finding(authority: Column, score: Column) -> Column:
    low = score < 40
    return _finding(
        6, "technical", "Technical", "Domain Authority", C.BENCHMARK_LABELS["authority"], score,
        F.when(low, "High").when(score < 70, "Medium").otherwise("Low"),
        _text("Authority estimate ", authority, " of 100."),
        F.when(low, "Weak pages lose contested rankings.").otherwise("The page supports its rankings."),
        F.when(low, "Add depth and internal links.").otherwise("Keep depth and internal links."),
        _text("Authority estimate: ", authority, "."),
    )


def nofollow_ratio(follow: Column, nofollow: Column) -> Column:
    return N.safe_divide(nofollow.cast("double"), (follow + nofollow).cast("double"))


def follow_score(ratio: Column) -> Column:
    return F.when(ratio <= 0.5, 100.0).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - (ratio - 0.5) * 200))


def follow_finding(follow: Column, nofollow: Column, ratio: Column, score: Column) -> Column:
    total = follow + nofollow
    heavy = ratio > 0.5
    return _finding(
        7, "links", "Links", "Link Type Distribution", C.BENCHMARK_LABELS["follow"], score,
        F.when(score < 50, "High").when(score < 90, "Medium").otherwise("Low"),
        _text(N.format_percentage(ratio * 100), " of ", total, " links are nofollow."),
        F.when(heavy, "Little link value is passed on.").otherwise("Link value is passed on."),
        F.when(heavy, "Drop nofollow from internal links.").otherwise("Keep the present mix."),
        _text(follow, " follow and ", nofollow, " nofollow links."),
    )


def link_density(internal: Column, external: Column) -> Column:
    total = internal + external
    return F.when(total > 0, N.round_half_even((internal / total) * 100, 1)).otherwise(0.0)


def density_attainment(density: Column) -> Column:
    share = N.round_half_even((density / F.lit(C.LINK_DENSITY_MIN)) * 100, 1)
    return F.when(density >= C.LINK_DENSITY_MIN, 100.0).otherwise(share)


def alt_coverage(total: Column, missing: Column) -> Column:
    return N.round_half_even((F.greatest(total - missing, F.lit(0)) / F.nullif(total, F.lit(0))) * 100, 1)


def density_score(internal: Column, external: Column, full: Column) -> Column:
    return (
        F.when(internal + external == 0, 0.0)
        .when(internal < 5, F.greatest(F.lit(0.0), full - 50))
        .when(external > 100, F.greatest(F.lit(0.0), full - 20))
        .otherwise(full)
    )


def density_finding(internal: Column, external: Column, density: Column, full: Column, score: Column) -> Column:
    """``density`` and ``full`` are ``link_density`` and ``density_attainment`` of the counts."""
    total = internal + external
    few, many = internal < 5, external > 100
    good = score >= 90
    return _finding(
        8, "links", "Links", "Internal Link Density", C.BENCHMARK_LABELS["links"], score,
        F.when((total == 0) | few | many | (full < 50), "High").when(full < 80, "Medium").otherwise("Low"),
        F.when(total == 0, F.lit("No links."))
        .when(few, _text("Only ", internal, " internal links."))
        .when(many, _text(external, " external links."))
        .otherwise(_text(N.format_percentage(density), " of the links are internal.")),
        F.when(total == 0, "Visitors and crawlers stop here.")
        .when(good, "Visitors and crawlers find the next page.")
        .otherwise("Few paths lead to other pages of the site."),
        F.when(good, "Keep the internal links.").otherwise("Link to related pages of the site."),
        _text(N.format_percentage(density), " internal of ", total, " links."),
    )


def image_score(total: Column, raw: Column) -> Column:
    return F.when(total <= 0, 100.0).when(raw < 40, F.greatest(F.lit(0.0), raw - 10)).otherwise(raw)


def image_finding(total: Column, missing: Column, raw: Column, score: Column) -> Column:
    """``raw`` is the ``alt_coverage`` of the counts."""
    good = score >= 90
    return _finding(
        9, "accessibility", "Accessibility", "Image Accessibility", C.BENCHMARK_LABELS["alt"], score,
        F.when(total <= 0, "Low").when(raw < 40, "High").when(raw < 80, "Medium").otherwise("Low"),
        F.when(total <= 0, F.lit("No images.")).otherwise(
            _text(N.format_percentage(raw), " of the images have alt text.")
        ),
        F.when(total <= 0, "Nothing to describe, and nothing to find in image search.")
        .when(good, "Images can be found and read aloud.")
        .otherwise("Some images can be neither found nor read aloud."),
        F.when(total <= 0, "Add helpful images with alt text.")
        .when(good, "Keep describing new images.")
        .otherwise("Describe every image."),
        _text(missing, " of ", total, " images lack alt text."),
    )


def page_speed_finding(score: Column, seconds: Column, size_kb: Column) -> Column:
    slow = score < 50
    return _finding(
        10, "performance", "Performance", "Page Speed", C.BENCHMARK_LABELS["speed"], score.cast("double"),
        F.when(slow, "High").when(score < 90, "Medium").otherwise("Low"),
        _text("Speed score ", score, "."),
        F.when(slow, "Slow pages lose visitors.").otherwise("Pages load fast enough to keep visitors."),
        F.when(slow, "Shrink images, cut scripts, cache.").otherwise("Keep the present setup."),
        _text("First byte after ", seconds, " s, ", size_kb, " KB."),
    )


def broken_links_finding(ratio: Column, checked: Column, broken: Column) -> Column:
    score = N.maximum_attainment(ratio, C.BROKEN_RATIO_MAX)
    return _finding(
        11, "links", "Links", "Broken Internal Links", "0-2% broken internal links", score,
        N.priority_from_score(score),
        _text(broken, " of ", checked, " checked links are broken."),
        F.when(ratio > C.BROKEN_RATIO_MAX, "Visitors and crawlers hit dead ends.").otherwise("Links work."),
        F.when(ratio > C.BROKEN_RATIO_MAX, "Repair or remove broken links.").otherwise("Keep checking."),
        _text(N.format_percentage(ratio), " of the checked links are broken."),
    )


# Three steps, each a projection on the one before: measures, scores, findings. The
# steps keep every expression small enough for generated code.
@cache
def _measures() -> list[Column]:
    c = F.col
    return [
        N.range_attainment(F.length("title"), C.TITLE_MIN, C.TITLE_MAX).alias("_title"),
        N.range_attainment(F.length("description"), C.META_MIN, C.META_MAX).alias("_meta"),
        nofollow_ratio(c("dofollow_links"), c("nofollow_links")).alias("_ratio"),
        link_density(c("internal_links_count"), c("external_links_count")).alias("_density"),
        alt_coverage(c("total_images"), c("missing_alt_count")).alias("_alt"),
    ]


@cache
def _scores() -> list[Column]:
    c = F.col
    flag = lambda name: F.when(c(name), 100.0).otherwise(0.0)
    scores = [
        _length_score(F.length("title"), c("_title"), 50, 15),
        _length_score(F.length("description"), c("_meta"), 60, 10),
        flag("has_canonical"),
        heading_score(c("h1_count")),
        flag("has_viewport_meta"),
        c("page_authority").cast("double"),
        follow_score(c("_ratio")),
        density_score(c("internal_links_count"), c("external_links_count"), c("_attained")),
        image_score(c("total_images"), c("_alt")),
    ]
    return [N.clamp(s).alias(f"_score{i}") for i, s in enumerate(scores)]


@cache
def page_findings() -> list[Column]:
    """The nine page rules in report order, on features, measures and scores."""
    c = F.col
    s = [c(f"_score{i}") for i in range(9)]
    return [
        _length_rule(
            1, "Title Optimization", "title", "title", F.length("title"),
            C.TITLE_MIN, C.TITLE_MAX, 50, c("_title"), s[0],
        ),
        _length_rule(
            2, "Meta Description", "meta description", "meta", F.length("description"),
            C.META_MIN, C.META_MAX, 60, c("_meta"), s[1],
        ),
        _flag_rule(
            3, "metadata", "Canonical Tag", C.BENCHMARK_LABELS["canonical"], c("has_canonical"), "canonical tag"
        ),
        heading_finding(c("h1_count"), s[3]),
        _flag_rule(
            5, "technical", "Mobile-First Readiness", C.BENCHMARK_LABELS["viewport"],
            c("has_viewport_meta"), "viewport tag",
        ),
        authority_finding(c("page_authority"), s[5]),
        follow_finding(c("dofollow_links"), c("nofollow_links"), c("_ratio"), s[6]),
        density_finding(
            c("internal_links_count"), c("external_links_count"), c("_density"), c("_attained"), s[7]
        ),
        image_finding(c("total_images"), c("missing_alt_count"), c("_alt"), s[8]),
    ]


# position of each metric in the metric summary, which has its own order
SUMMARY_ORDER = [1, 2, 4, 5, 3, 6, 7, 9, 8]

_KEYS = ["page_id", "site", "url"]
_MODULES = {
    "metadata": [0, 1, 2], "headings": [3], "technical": [4, 5], "links": [6, 7], "accessibility": [8],
}


def page_audit(features: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Findings, module scores, weighted score, breakdown and key issue per page."""
    performance = (
        F.coalesce(F.col("performance_score").cast("double"), F.lit(100.0))
        if "performance_score" in features.columns
        else F.lit(100.0)
    )
    attained = density_attainment(F.col("_density")).alias("_attained")
    measured = features.select("*", *_measures()).select("*", attained).select("*", *_scores())

    def mean(indexes: list[int]) -> Column:
        acc = F.col(f"_score{indexes[0]}")
        for i in indexes[1:]:
            acc = acc + F.col(f"_score{i}")
        return acc / F.lit(float(len(indexes)))

    scored = (
        measured.select(
            *_KEYS, *keep, performance.alias("performance_score"),
            # as a higher-order function the big array is split over several methods
            F.array_compact(F.array(*page_findings())).alias("findings"),
            *[mean(ix).alias(f"_{m}") for m, ix in _MODULES.items()],
        )
        .select(
            *_KEYS, *keep, "performance_score", "findings",
            *[N.round_half_even(F.col(f"_{m}"), 1).alias(f"{m}_score") for m in _MODULES],
        )
    )
    scores = {m: F.col(f"{m}_score") for m in C.PAGE_WEIGHTS}
    failing = lambda category: F.try_element_at(
        F.filter(
            F.col("findings"), lambda f: (F.lower(f["category"]) == category) & (f["score"] < 80)
        ),
        F.lit(1),
    )
    breakdown = F.array(
        *[
            F.struct(
                F.lit(module).alias("module"),
                scores[module].alias("score"),
                F.coalesce(failing(module)["priority"], F.lit("Low")).alias("impact"),
                F.coalesce(failing(module)["metric"], F.lit("No major issues")).alias("reason"),
            )
            for module in C.PAGE_WEIGHTS
        ]
    )
    with_breakdown = scored.select(
        "*",
        N.weighted_score(scores, C.PAGE_WEIGHTS).alias("overall_score"),
        breakdown.alias("score_breakdown"),
    )
    lowest = F.array_min(
        F.transform(
            "score_breakdown",
            lambda b, i: F.struct(b["score"].alias("score"), i.alias("pos"), b["module"].alias("module"), b["reason"].alias("reason")),
        )
    )
    return with_breakdown.withColumn("_low", lowest).select(
        *[c for c in with_breakdown.columns],
        N.format_percentage(F.col("overall_score")).alias("overall_seo_health"),
        F.when(
            F.col("_low.score") < 80,
            F.concat(F.initcap("_low.module"), F.lit(": "), F.col("_low.reason")),
        ).otherwise("None").alias("key_issue"),
    )


def findings(audited: DataFrame) -> DataFrame:
    """Long form: one row per page and finding."""
    return unnest(audited, "findings", "f", _KEYS).select(*_KEYS, "f.*").withColumn(
        "priority_rank", N.priority_rank(F.col("priority"))
    )


def module_issues(audited: DataFrame) -> DataFrame:
    """Score, failing metrics and recommendations of every page module."""
    def entry(module: str) -> Column:
        failed = F.filter("findings", lambda f: (f["module"] == module) & (f["score"] < 80))
        return F.struct(
            F.lit(module).alias("module"), F.col(f"{module}_score").alias("score"), failed.alias("failed")
        )

    rows = [entry(m) for m in C.PAGE_WEIGHTS]
    return (
        unnest(audited, F.array(*rows), "m", _KEYS)
        .select(
            *_KEYS,
            "m.module",
            "m.score",
            F.transform("m.failed", lambda f: f["metric"]).alias("issues"),
            F.transform("m.failed", lambda f: f["recommendation"]).alias("recommendations"),
        )
    )


def failing(long: DataFrame) -> DataFrame:
    return long.filter(F.col("score") < 80)


def evidence(
    pages: DataFrame, metric: str, predicate: Column, observation: Column, limit: int = C.EVIDENCE_LIMIT,
    order: str = "page_id",
) -> DataFrame:
    """First ``limit`` pages of each site that meet the predicate, with an observation.

    The row number is bounded, so every task keeps only its first rows before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy(order)
    return (
        pages.filter(predicate)
        .select("site", F.lit(metric).alias("metric"), "url", observation.alias("observation"), order)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
    )


@dataclass
class RuleSet:
    """User rules next to the built-in ones: predicate, score and message Columns.

    All rules become one array, exploded once, however many there are.
    """

    rules: list[Column] = field(default_factory=list)

    def add(
        self, name: str, category: str, predicate: Column, message: Column | str,
        score: Column | float = 0.0, severity: str = "Medium",
    ) -> "RuleSet":
        value = score if isinstance(score, Column) else F.lit(float(score))
        text = message if isinstance(message, Column) else F.lit(message)
        self.rules.append(
            F.when(
                predicate,
                F.struct(
                    F.lit(len(self.rules) + 1).alias("rule_pos"),
                    F.lit(name).alias("rule"),
                    F.lit(category).alias("category"),
                    F.lit(severity).alias("severity"),
                    N.clamp(value.cast("double")).alias("score"),
                    text.alias("message"),
                ),
            )
        )
        return self

    def as_array(self) -> Column:
        return F.array_compact(F.array(*self.rules))

    def apply(self, features: DataFrame, keys: list[str] = ("site", "page_id", "url")) -> DataFrame:
        return unnest(features, self.as_array(), "r", list(keys)).select(*keys, "r.*")
