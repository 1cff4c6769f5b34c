"""Row-level validation of feed text: one machine-readable reason per rejected row.

The order of the tests is part of the result: missing mandatory value, repeated
key, bad date, bad energy, bad emissions. The first failing test is the reason.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.config import FeedRules
from meterline.functions.joins import mark_repeats, number_rows
from meterline.functions.numbers import number_text, parse_number
from meterline.functions.times import strict_date

# Fixed value: ranges of these columns are tested in this order, before those of any others in configured order.
NUMERIC_ORDER = ["energy_kwh", "emissions_co2e"]
DUPLICATE = "duplicate_record_id"
BAD_DATE = "invalid_date_format"


def text_of(df: DataFrame, column: str) -> Column:
    """Trimmed text; a column the feed lacks reads as blank."""
    return F.coalesce(F.trim(F.col(column)), F.lit("")) if column in df.columns else F.lit("")


def null_reason(df: DataFrame, rules: FeedRules) -> Column:
    """`null:<column>` for the first blank mandatory column, in configured order."""
    tests = [
        F.when(text_of(df, c) == "", F.lit(f"null:{c}")) for c in rules.mandatory_not_null
    ]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def date_reason(df: DataFrame, rules: FeedRules) -> Column:
    return F.when(strict_date(text_of(df, rules.date_column)).isNull(), F.lit(BAD_DATE))


def range_reason(df: DataFrame, rules: FeedRules, column: str) -> Column:
    """Cast and range test of one configured column; blanks pass."""
    text = text_of(df, column)
    return _range_reason(rules, column, text, parse_number(text))


def _range_reason(rules: FeedRules, column: str, text: Column, number: Column) -> Column:
    limits = rules.numeric_range.get(column)
    if limits is None or rules.is_dimension:
        return F.lit(None).cast("string")
    outside = F.lit(False)
    if limits.get("min") is not None:
        outside = outside | (number < float(limits["min"]))
    if limits.get("max") is not None:
        outside = outside | (number > float(limits["max"]))
    bad_text = F.when(text != "", F.lit(f"invalid_value:{column}"))
    return F.when(number.isNull(), bad_text).when(
        outside, F.concat(F.lit(f"range_violation:{column}="), number_text(number))
    )


def _per_dataset(rules: list[FeedRules], dataset: str, build, kind: str = "string") -> Column:
    """One expression that applies each feed's own rule; feeds with equal rules share a branch."""
    groups: dict[str, list[FeedRules]] = {}
    for rule in rules:
        groups.setdefault(repr(replace(rule, name="")), []).append(rule)
    return reduce(
        lambda acc, same: F.when(F.col(dataset).isin([r.name for r in same]), build(same[0])).otherwise(acc),
        groups.values(),
        F.lit(None).cast(kind),
    )


def validate_rows(
    df: DataFrame,
    rules: Iterable[FeedRules],
    dataset: str = "dataset",
    file: str = "file_name",
    position: str = "row_index",
    few: bool = False,
) -> DataFrame:
    """Add every test's outcome, the first reason and the parsed values.

    The repeated-key test looks at all earlier rows of the file, rejected ones
    included. It is the only test that moves data, and it moves only keys that
    occur more than once; not even those if the rows are `few` enough for one
    task. Text is trimmed, and dates and numbers are parsed, once per row.
    """
    rules = list(rules)
    used = [c for c in dict.fromkeys(c for r in rules for c in (*r.required_columns, *r.mandatory_not_null, *r.numeric_range, r.date_column)) if c in df.columns]
    clean = df.withColumns({c: text_of(df, c) for c in used})
    keys = {r.primary_key[0] for r in rules}
    if len(keys) == 1:
        key, marked = next(iter(keys)), clean
    else:
        key = "_pk"
        pick = _per_dataset(rules, dataset, lambda r: F.col(r.primary_key[0]) if r.primary_key[0] in df.columns else F.lit(""))
        marked = clean.withColumn(key, pick)
    marked = mark_repeats(marked, [file, key], position, "_repeat", few).drop("_pk")

    def column(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    def stage(build, kind: str = "string") -> Column:
        return _per_dataset(rules, dataset, build, kind)

    parsed = marked.withColumns(
        {
            "_day": stage(lambda r: strict_date(column(r.date_column)), "date"),
            "_energy": parse_number(column("energy_kwh")),
            "_emissions": parse_number(column("emissions_co2e")),
        }
    )

    def blank(r: FeedRules) -> Column:
        tests = [F.when(column(c) == "", F.lit(f"null:{c}")) for c in r.mandatory_not_null]
        return F.coalesce(*tests, F.lit(None).cast("string"))

    def others(r: FeedRules) -> Column:
        tests = [_range_reason(r, c, column(c), parse_number(column(c))) for c in r.numeric_range if c not in NUMERIC_ORDER]
        return F.coalesce(*tests, F.lit(None).cast("string"))

    tested = parsed.withColumns(
        {
            "null_reason": stage(blank),
            "repeat_reason": F.when(F.col("_repeat"), F.lit(DUPLICATE)),
            "date_reason": F.when(F.col("_day").isNull(), F.lit(BAD_DATE)),
            "energy_reason": stage(lambda r: _range_reason(r, "energy_kwh", column("energy_kwh"), F.col("_energy"))),
            "emissions_reason": stage(lambda r: _range_reason(r, "emissions_co2e", column("emissions_co2e"), F.col("_emissions"))),
            "other_reason": stage(others),
        }
    )
    reason = F.coalesce("null_reason", "repeat_reason", "date_reason", "energy_reason", "emissions_reason", "other_reason")
    judged = tested.withColumn("rejection_reason", reason)
    return judged.withColumn(
        "validation_status", F.when(F.col("rejection_reason").isNull(), "VALID").otherwise("REJECTED")
    ).drop("_repeat")


def _number_if(rules: list[FeedRules], dataset: str, column: str, parsed: str, passed: Sequence[str]) -> Column:
    """The parsed number, where the test sequence got as far as this column."""
    ranged = [r.name for r in rules if column in r.numeric_range and not r.is_dimension]
    reached = F.coalesce(*[F.col(p) for p in passed]).isNull()
    return F.when(reached & F.col(dataset).isin(ranged), F.col(parsed))


def stage_readings(
    validated: DataFrame,
    rules: Iterable[FeedRules],
    dataset: str = "dataset",
    position: str = "row_index",
    source_system: Column | None = None,
) -> DataFrame:
    """Project validated reading rows to the staging layout (without the running id).

    Numbers are kept only as far as the test sequence got; the date is kept
    whenever the text is a real date. `position` is the 0-based data row.
    """
    rules = list(rules)
    record, site = F.col("record_id"), F.col("site_id")
    file_row = (F.col(position) + 2).cast("string")
    earlier = ["null_reason", "repeat_reason", "date_reason"]
    return validated.select(
        "batch_id",
        dataset,
        F.col(position).alias("row_index"),
        F.when(record != "", record).otherwise(F.concat(F.lit("UNKNOWN-"), file_row)).alias("record_id"),
        F.when(site != "", site).alias("site_id"),
        F.col("_day").alias("reading_date"),
        _number_if(rules, dataset, "energy_kwh", "_energy", earlier).alias("energy_kwh"),
        _number_if(rules, dataset, "emissions_co2e", "_emissions", [*earlier, "energy_reason"]).alias("emissions_co2e"),
        F.col("file_name").alias("source_file_name"),
        (source_system if source_system is not None else F.lit("UNKNOWN")).alias("source_system"),
        "validation_status",
        "rejection_reason",
    )


def stage_sites(validated: DataFrame, position: str = "row_index", default_date: str = "2023-01-01") -> DataFrame:
    """Project validated site-master rows; blank ids and bad dates take fixed stand-ins."""
    site = text_of(validated, "site_id")
    reached = F.when(F.coalesce("null_reason", "repeat_reason").isNull(), F.col("_day"))
    return validated.select(
        "batch_id",
        F.col(position).alias("row_index"),
        F.when(site != "", site).otherwise(F.lit("UNKNOWN")).alias("site_id"),
        *[text_of(validated, c).alias(c) for c in ("site_name", "country", "region", "site_type")],
        F.coalesce(reached, F.lit(default_date).cast("date")).alias("effective_from_date"),
        F.col("file_name").alias("source_file_name"),
        "validation_status",
        "rejection_reason",
    )


def assign_staging_ids(staged: DataFrame, order: list[Column], batch: str = "batch_id") -> DataFrame:
    """`S-<batch>-<n>` with n counting through the whole batch in `order`."""
    numbered = number_rows(staged, [batch], order, "_n")
    return numbered.withColumn(
        "staging_id", F.concat(F.lit("S-"), F.col(batch), F.lit("-"), F.col("_n").cast("string"))
    ).drop("_n")


def load_stats(validated: DataFrame, keys: list[str], rules: Iterable[FeedRules]) -> DataFrame:
    """Per group: rows read, valid, rejected and the count of each kind of rejection, in one pass."""
    mandatory = list(dict.fromkeys(c for r in rules for c in r.mandatory_not_null))
    reason = F.col("rejection_reason")
    nulls = [F.count_if(reason == f"null:{c}").alias(f"_null_{c}") for c in mandatory]
    stats = validated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_read"),
        F.count_if(reason.isNull()).alias("total_valid"),
        F.count_if(reason.isNotNull()).alias("total_rejected"),
        F.count_if(reason == BAD_DATE).alias("invalid_dates"),
        F.count_if(reason.startswith("invalid_value:") | reason.startswith("range_violation:")).alias(
            "range_violations"
        ),
        F.count_if(reason == DUPLICATE).alias("duplicates"),
        *nulls,
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_null_{c}").alias("value")) for c in mandatory])
    found = F.filter(pairs, lambda p: p["value"] > 0)
    return stats.withColumn("nulls_by_column", F.map_from_entries(found)).drop(*[f"_null_{c}" for c in mandatory])


def rejected_rows(validated: DataFrame, position: str = "row_index") -> DataFrame:
    """Evidence rows: parseable numbers and the raw date text survive the rejection."""
    record = text_of(validated, "record_id")
    site, day = text_of(validated, "site_id"), text_of(validated, "reading_date")
    file_row = F.concat(F.lit("(row "), (F.col(position) + 2).cast("string"), F.lit(")"))
    return validated.filter(F.col("rejection_reason").isNotNull()).select(
        *[c for c in ("batch_id", "dataset") if c in validated.columns],
        F.when(record != "", record).otherwise(file_row).alias("record_id"),
        F.when(site != "", site).alias("site_id"),
        F.when(day != "", day).alias("reading_date"),
        F.col("_energy").alias("energy_kwh"),
        F.col("_emissions").alias("emissions_co2e"),
        F.col("rejection_reason"),
        F.col("file_name").alias("source_file"),
    )


def _issue(when: Column, column: str, kind: Column, suggestion: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(column).alias("column_name"),
            kind.alias("issue_type"),
            F.lit("ERROR").alias("severity"),
            suggestion.alias("suggested_value"),
        ),
    )


def collect_issues(df: DataFrame, dataset: str, typed: bool = True) -> DataFrame:
    """The second rule set: every issue of a row, for typed (numeric) feed columns.

    A column absent from the feed is undefined, a null cell is null; the two
    give different issue types for emissions.
    """
    none = F.lit(None).cast("string")
    issues: list[Column] = []
    if dataset == "energy_consumption":
        site = F.col("site_id").cast("string") if "site_id" in df.columns else none
        issues.append(
            _issue(F.coalesce(F.trim(site), F.lit("")) == "", "site_id", F.lit("NULL_VALUE"), none)
        )
        energy = F.col("energy_kwh").cast("double") if "energy_kwh" in df.columns else F.lit(None).cast("double")
        negative = F.coalesce(energy < 0, F.lit(False))
        issues.append(
            _issue(
                energy.isNull() | negative,
                "energy_kwh",
                F.when(negative, "OUT_OF_RANGE").otherwise("NULL_VALUE"),
                F.when(negative, F.lit("0")),
            )
        )
    elif dataset == "carbon_emissions":
        if "emissions_co2e" in df.columns:
            value = F.col("emissions_co2e").cast("double")
            negative = F.coalesce(value < 0, F.lit(False))
            falsy = value.isNull() | (value == 0) | F.isnan(value)
            issues.append(
                _issue(falsy | negative, "emissions_co2e", F.lit("OUT_OF_RANGE"), F.when(negative, F.lit("0")))
            )
        else:
            issues.append(_issue(F.lit(True), "emissions_co2e", F.lit("NULL_VALUE"), none))
    elif dataset == "site_master":
        blank = reduce(
            lambda a, b: a | b,
            [
                (F.coalesce(F.col(c), F.lit("")) == "") if c in df.columns else F.lit(True)
                for c in ("site_id", "site_name", "country")
            ],
        )
        issues.append(_issue(blank, "site_id|site_name|country", F.lit("NULL_VALUE"), none))
    found = F.filter(F.array(*issues), lambda i: i.isNotNull())
    out = df.withColumn("issues", found)
    return out.withColumn("accepted", F.size("issues") == 0)
