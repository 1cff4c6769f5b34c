"""Document quality rules in a cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import pick
from meterline.session import cut_lineage

SAMPLE_ROWS = 2_000
WINDOW = 5
SPACES = " \t\n\u000b\f\r"
RUN_WORDS = 50


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_measures(text: Column) -> dict[str, Column]:
    """What the default rules look at, each as an expression of its own over the text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(without(line, SPACES)) > 0)
    return {
        "text": text,
        "n_words": F.size(words_of(text)),
        "word_chars": F.length(without(text, SPACES)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
    }


def default_rules(measures: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Rules that reject a document when they hold, over `measures` or else over the column `text`."""
    m = text_measures(F.col("text")) if measures is None else measures
    words = words_of(m["text"])
    return {
        "few_words": m["n_words"] < 10,
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "capitals": 2 * F.regexp_count(m["text"], F.lit("[A-Z]")) > m["word_chars"],
        "repeated_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] > 15 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]),
        "stutter": F.when(m["n_words"] < RUN_WORDS, 4 * F.size(F.array_distinct(words)) < 3 * m["n_words"]),
    }


def hash_sample(docs: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About `rows` rows of `docs`, those with the smallest seeded hash of their key."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 32) < int(share * 2**32))


def cascade_order(sample: DataFrame, rules: Mapping[str, Column]) -> list[str]:
    """Rule names by rejections per second, each judged on what the rules before it let pass.

    Every rule is timed on the written sample and one grouped count gives all
    joint selectivities. The order only decides the work: any order accepts the
    same documents.
    """
    names = list(rules)
    seconds = {}
    for name in names:
        spent = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(rules[name])).collect()
            spent.append(time.perf_counter() - began)
        seconds[name] = min(spent)
    flags = [F.coalesce(rules[name], F.lit(False)).alias(name) for name in names]
    patterns = [(tuple(row[:-1]), row[-1]) for row in sample.select(*flags).groupBy(*names).count().collect()]
    order: list[str] = []
    while len(order) < len(names):
        rejected = {
            name: sum(n for flagged, n in patterns if flagged[names.index(name)]) for name in names if name not in order
        }
        best = max(rejected, key=lambda name: (rejected[name] / seconds[name], -seconds[name], name))
        order.append(best)
        patterns = [(flagged, n) for flagged, n in patterns if not flagged[names.index(best)]]
    return order


def first_failed(rules: Mapping[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, null when all pass; later rules are not evaluated after a rejection."""
    verdict = F.when(rules[order[0]], F.lit(order[0]))
    for name in order[1:]:
        verdict = verdict.when(rules[name], F.lit(name))
    return verdict


def quality_cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, failed_rule and kept of every document under the default rules.

    A null text counts as empty; an empty text fails `few_words`. Repeated rows
    and null ids keep their rows, an empty table gives none, further columns
    are ignored.
    """
    narrow = plain(docs)
    rules = default_rules()
    order = cascade_order(cut_lineage(hash_sample(narrow, rows=sample_rows)), rules)
    return narrow.withColumn("failed_rule", first_failed(rules, order)).withColumn("kept", F.col("failed_rule").isNull())


def plain(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))


def text_counts(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words next to the columns of `docs`.

    Windows of five words are compared by a 64-bit hash chained over the hashes
    of their words. Only texts with a repeated window sort their windows.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(without(line, SPACES)) > 0)
    counted = (
        docs.withColumn("_hashes", F.transform(words_of(text), lambda w: F.xxhash64(w)))
        .withColumn("n_words", F.size("_hashes").cast("long"))
        .withColumn("word_chars", F.length(without(text, SPACES)).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
    )
    starts = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    keyed = counted.withColumn(
        "_windows", F.when(F.size("_hashes") >= WINDOW, F.transform(starts, window)).otherwise(F.array().cast("array<bigint>"))
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.transform("_windows", lambda key, i: F.struct(key.alias("key"), i.alias("at")))
    empty = F.array().cast("array<struct<key:bigint,at:int>>")
    sorted_pairs = keyed.withColumn("_sorted", F.when(repeated, F.sort_array(pairs)).otherwise(empty)).drop("_windows", "_hashes")
    twin = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(F.get("_sorted", i - 1)["key"] == x["key"], F.lit(False))
        | F.coalesce(F.get("_sorted", i + 1)["key"] == x["key"], F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(twin, lambda x: x["at"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    return sorted_pairs.withColumn("n_repeat_words", covered).drop("_sorted")


def rule_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts and verdicts of every document: a base rejection, then the cascade.

    Base: fewer than ten words, or over 20 % of the words in repeated windows.
    Same conventions as `quality_cascade`.
    """
    narrow = plain(docs)
    counts = ("text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    rules = default_rules({name: F.col(name) for name in counts})
    order = cascade_order(cut_lineage(text_counts(hash_sample(narrow, rows=sample_rows))), rules)
    verdict = first_failed(rules, order)
    counted = text_counts(narrow).withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("kept")).alias("kept"),
        "failed_rule",
    )
