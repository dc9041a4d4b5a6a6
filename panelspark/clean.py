"""Cleaning and scalar building blocks. All functions make columns or DataFrames and run in Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing one.
BLANKS = "(?i)^(|none|null|nan|empty)$"
#: Degree words and their ordinal scores; the first match wins.
DEGREES = (("doctor", 5), ("phd", 5), ("mba", 4), ("master", 4), ("bachelor", 3), ("associate", 2), ("high school", 1))


def nullify_blank(c: Column) -> Column:
    """Null for blank and null-like texts; else trimmed with runs of white space as one blank."""
    t = F.trim(c)
    return F.when(~t.rlike(BLANKS), F.regexp_replace(t, r"\s+", " "))


def clean_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``nullify_blank`` on those of ``columns`` that exist."""
    return df.withColumns({c: nullify_blank(F.col(c)) for c in existing(df, columns)})


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def ensure_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def normalize_text(*columns: Column, strip_upper: bool = False) -> Column:
    """Concatenated lower-cased letters and digits, others as blanks; ``strip_upper`` drops capitals before (old behaviour)."""
    text = F.concat_ws(" ", *columns)
    if strip_upper:
        return F.trim(F.lower(F.regexp_replace(text, "[^a-z0-9]+", " ")))
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """``missing`` for null; else lower-cased with runs of other characters as one underscore, none at the ends."""
    body = F.regexp_replace(F.lower(F.coalesce(c, F.lit("missing"))), "[^a-z0-9]+", "_")
    return F.regexp_replace(body, "^_+|_+$", "")


def safe_divide(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def cast_if_present(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.withColumn(column, F.col(column).try_cast(kind)) if column in df.columns else df


def clip_year(c: Column, end: Column, start: int = 1950) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(start)), end))


def degree_score(c: Column, degrees: Sequence[tuple[str, int]] = DEGREES) -> Column:
    text = F.lower(c)
    return reduce(lambda out, d: out.when(text.contains(d[0]), d[1]), degrees[1:], F.when(text.contains(degrees[0][0]), degrees[0][1]))


def flag(condition: Column) -> Column:
    """1 or 0; 0 where the condition is unknown."""
    return F.when(condition, 1).otherwise(0)


def entity_key(parent: Column, name: Column, fallback: Column) -> Column:
    """``parent_<id>``, else ``name_<slug>``, else ``unknown_position_<id>``."""
    return (
        F.when(parent.isNotNull(), F.concat(F.lit("parent_"), parent.cast("string")))
        .when(name.isNotNull(), F.concat(F.lit("name_"), slug(name)))
        .otherwise(F.concat(F.lit("unknown_position_"), fallback.cast("string")))
    )


def weight(c: Column) -> Column:
    """Non-negative weight, 1 where missing."""
    return F.greatest(F.coalesce(c.cast("double"), F.lit(1.0)), F.lit(0.0))


def industry_prefix(c: Column, digits: int = 3) -> Column:
    """First digits of an industry code, null where it has none."""
    return F.nullif(F.substring(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 1, digits), F.lit(""))


def duration_days(start: Column, end: Column, clamp: bool = True) -> Column:
    days = F.datediff(end, start)
    return F.when(days >= 0, days) if clamp else days


def log1p_filled(c: Column) -> Column:
    return F.log1p(F.coalesce(c, F.lit(0.0)))


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def log_floor(c: Column) -> Column:
    """Log of the value or of 1, whichever is more."""
    return F.log(F.greatest(c, F.lit(1)))


def root(c: Column) -> Column:
    """Square root; null for what is below 0."""
    return F.when(c >= 0, F.sqrt(c))


def prefix_columns(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def scrub(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null for NaN and infinities, then only rows with all of ``columns``."""
    odd = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in columns}
    return df.withColumns(odd).na.drop(subset=list(columns))


def one_hot(c: Column, categories: Sequence[str], prefix: str) -> dict[str, Column]:
    return {prefix + k.lower().replace(" ", "_"): flag(c == k) for k in categories}


def regex_flags(text: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """One 0/1 column for each pattern; null text gives 0."""
    return {name: flag(text.rlike(p)) for name, p in patterns.items()}


def text_flags(texts: Mapping[str, Column], dictionaries: Mapping[str, str]) -> dict[str, Column]:
    """A flag of each text under each dictionary, ``<text>_<dictionary>``, and ``any_<dictionary>`` of all texts."""
    out: dict[str, Column] = {}
    for name, pattern in dictionaries.items():
        own = {f"{t}_{name}": flag(c.rlike(pattern)) for t, c in texts.items()}
        out |= own | {f"any_{name}": F.greatest(*own.values()) if len(own) > 1 else next(iter(own.values()))}
    return out


def role_flags(levels: Sequence[Column], patterns: Mapping[str, str]) -> dict[str, Column]:
    """Flags on the normalised text of a role hierarchy, finest level to broadest."""
    return regex_flags(normalize_text(*levels), patterns)


def proximity_flags(text: Column, categories: Mapping[str, tuple[Sequence[str], Sequence[str]]], within: int = 80) -> dict[str, Column]:
    """A flag of each category, whose words of one list stand near one of the other, and ``broad`` for any of them."""
    flags = {name: flag(text.rlike(near(a, b, within))) for name, (a, b) in categories.items()}
    return flags | {"broad": F.greatest(*flags.values()) if len(flags) > 1 else next(iter(flags.values()))}


def rank_flags(degree: Column, world: Column, national: Column, other: Column | None = None) -> dict[str, Column]:
    """Degree of at least 3 and 4 and a school among the first 500 of the world or 100 of the country; unknown is 0.

    With ``other``, a second degree score, the better of both counts.
    """
    best = F.greatest(degree, other) if other is not None else degree
    return {"best_degree": best, "has_bachelor": flag(best >= 3), "has_master": flag(best >= 4), "has_top_school": flag((world <= 500) | (national <= 100))}


def in_sample(support: Column, size: Column, least: float, industry: Column) -> Column:
    """1 where there is support, enough size and a known industry."""
    return flag((support > 0) & (size >= least) & industry.isNotNull())


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls column by column; names that the table lacks are passed over."""
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def joint_label(a: Column, year: Column) -> Column:
    """``<a>_y<year>``: the label of a joint fixed effect, where a table has to carry one."""
    return F.concat(a.cast("string"), F.lit("_y"), year.cast("string"))


def first_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of the candidates that the table has."""
    found = existing(df, candidates)
    if not found:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return found[0]


def restrict(df: DataFrame, share: str | None = None, sample: str | None = None) -> DataFrame:
    """Only rows with some share in a region, and only those in the sample, where these are asked for."""
    df = df.where(F.col(share) > 0) if share else df
    return df.where(F.col(sample) == 1) if sample else df


#: The named samples of a robustness grid, by the condition that their rows meet.
SAMPLES = {
    "baseline": "true",
    "min_workers_20": "n_workers >= 20",
    "min_workers_50": "n_workers >= 50",
    "drop_top_group_a_decile": "top_decile_group_a <> 1",
    "drop_top_group_b_decile": "top_decile_group_b <> 1",
    "drop_top_any_decile": "top_decile_group_a <> 1 and top_decile_group_b <> 1",
}


def sample_filter(df: DataFrame, name: str) -> DataFrame:
    """Rows of one of ``SAMPLES``; a flag that is unknown drops its row."""
    if name not in SAMPLES:
        raise ValueError(f"unknown sample {name}; there are {', '.join(SAMPLES)}")
    return df.where(SAMPLES[name])


def near(first: Sequence[str], second: Sequence[str], within: int = 80) -> str:
    """Pattern for a word of ``first`` followed by one of ``second`` within so many characters, or the other way."""
    a, b = "|".join(first), "|".join(second)
    return f"({a}).{{0,{within}}}({b})|({b}).{{0,{within}}}({a})"


def explode_labels(df: DataFrame, flags: Sequence[str], out: str) -> DataFrame:
    """One row for each flag that is set, named by it; rows without any go."""
    labels = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in flags)))
    return df.withColumn(out, F.explode(labels))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by a total order."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")
