"""Quality rules as a short-circuit cascade (DataFrame operations only)."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A test that rejects a document. ``rejects`` is built from the text, its words and the base
    statistics by name; it is never null."""

    name: str
    rejects: Column


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def default_rules() -> list[Rule]:
    """The production rules; a clean text in any language passes each with room to spare."""
    n, text, words = F.col("n_words"), F.col("__text"), F.col("__words")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    with_letter = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    distinct = F.size(F.array_distinct(words))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.col("__n_lines")),
        Rule("exclamations", 4 * count_of(text, "!?") > n),
        Rule("letter_words", 10 * with_letter < 6 * n),
        Rule("vocabulary", 100 * distinct < 5 * F.least(n, F.lit(2000))),
        Rule("capitals", 10 * capitals > 6 * letters),
    ]


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, characters, symbols, repeated lines and repeated 3-word windows.

    Windows are compared by a 64-bit hash of their words. A text whose windows are all different
    (most are) is done after one hash set of them; only others are sorted.
    """
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    stripped = F.btrim(F.col("__text"), F.lit(SPACES))
    df = df.withColumn("__words", F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACE)))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    # The lambda's element and index stand for the window's first word; the array itself gives the other two.
    window = F.transform(F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__windows", window)
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("__lines", lines)
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    ranked = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__ranked", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), ranked))
    again = F.filter("__ranked", lambda x, i: same(F.get("__ranked", i - 1)["h"], x["h"]) | same(F.get("__ranked", i + 1)["h"], x["h"]))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])
    return df.select(
        "doc_id",
        "__text",
        "__words",
        "n_words",
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def cascade_order(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, repeats: int = 3) -> list[Rule]:
    """The rules by rejections per cost, best first, as measured on about ``sample_rows`` rows that a
    hash of id and text picks from all; a rule's cost is the least of ``repeats`` timings. The order
    decides the time that the cascade takes, never which documents pass it. The sample is written
    by the tasks that read it; no text comes to the driver."""
    share = max(1, docs.count() // max(1, sample_rows))
    picked = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(share)) == 0)
    sample = materialize(base_statistics(picked, id_col, text_col), "quality-sample").coalesce(docs.sparkSession.sparkContext.defaultParallelism)

    def timed(*columns: Column) -> tuple[float, list]:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            row = sample.agg(F.count(F.lit(1)), *columns).first()
            took.append(time.perf_counter() - began)
        return min(took), list(row)

    idle = timed(F.sum(F.length("__text")), F.sum(F.size("__words")))[0]
    rate = {}
    for rule in rules:
        seconds, (rows, rejected) = timed(F.sum(rule.rejects.cast("int")))
        rate[rule.name] = (rejected or 0) / max(1, rows) / max(seconds - 0.8 * idle, 1e-3)
    return sorted(rules, key=lambda r: (-rate[r.name], r.name))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, min_words: int = 50, sample_rows: int = 1000) -> DataFrame:
    """Base statistics and verdict of each document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    kept. A rule is evaluated only for documents that all rules before it let pass; which one
    rejected a document isn't told, as that depends on the order measured. One row comes out per
    row, so null ids and repeated rows are kept apart, and an empty table gives an empty one. Null and empty texts have no words and fail the
    base. There is no shuffle, and other columns are ignored.
    """
    stats = base_statistics(docs, id_col, text_col)
    rules = cascade_order(docs, default_rules() if rules is None else rules, id_col, text_col, sample_rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cascade = F.when(failed, F.lit(True))
    for rule in rules:
        cascade = cascade.when(rule.rejects, F.lit(True))
    kept = ~F.coalesce(cascade, F.lit(False))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"))
