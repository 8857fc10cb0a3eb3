"""Quality rules: a threshold table compiled into one Spark projection. [native: SQL functions only]

``measure`` adds the counts that rules read, ``verdict`` compiles a table of rules into one boolean expression,
``apply_rules`` does both. Everything is row-local: no shuffle, no user function, one pass over the text.

Edge cases: a null text counts as empty; an empty text has no words, so the base rule fails it. Rows with a null
doc_id, repeated rows and further columns pass through; the counts are added under the names below, replacing input
columns of the same name. Texts of any length are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: What separates words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "with", "for", "be"),
    "de": ("der", "die", "und", "das", "ist", "den", "nicht", "von", "mit", "zu"),
    "fr": ("le", "la", "les", "de", "et", "des", "un", "une", "est", "que"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "una", "con"),
}
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a document only while low * whole <= part <= high * whole; a None bound is open."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        part, whole = F.col(self.part).cast("double"), F.col(self.whole).cast("double")
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (part >= self.low * whole)
        if self.high is not None:
            ok = ok & (part <= self.high * whole)
        return ok


RULES = (
    Rule("word length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measure(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with the counts of COUNTS, all long."""
    own = [c for c in docs.columns if c.lower() not in COUNTS]
    text, words, lines, count, hashes, sorted_, size, places = unused([*own, *COUNTS], "t", "w", "l", "n", "h", "s", "m", "p")
    t = docs.select(*own, F.coalesce("text", F.lit("")).alias(text))
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    t = t.select("*", F.array_remove(F.split(text, SPACE), "").alias(words), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias(lines))
    t = t.select(
        "*",
        F.size(words).alias(count),
        F.when(F.size(words) > WINDOW, F.transform(words, lambda w: F.xxhash64(w))).alias(hashes),
    )
    # A window is hashed by the hashes of its words.
    window = F.transform(F.sequence(F.lit(1), F.col(count) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    t = t.withColumn(hashes, F.when(F.col(hashes).isNotNull(), window))
    # Only texts in which some window repeats pay for the sort that finds where.
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    t = t.select("*", F.when(repeats, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(sorted_))
    t = t.drop(hashes).withColumn(size, F.size(sorted_))
    at = lambda k: F.get(sorted_, k)["h"]
    found = F.filter(sorted_, lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
    t = t.withColumn(places, F.when(F.col(size) > 0, F.array_sort(F.transform(found, lambda x: x["i"]))))
    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).alias("n"))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    lower = F.transform(words, lambda w: F.lower(w))
    return t.select(
        *own,
        F.col(count).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lower, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of rules as one expression; the base rule comes first."""
    ok = ~base_failed()
    for rule in rules:
        ok = ok & rule.passes()
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with COUNTS, base_failed, kept and failed (names of the rules against the document)."""
    out = measure(docs.select(*(c for c in docs.columns if c.lower() not in ("base_failed", "kept", "failed"))))
    failed = F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rules))
    return out.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"), F.filter(failed, lambda x: x.isNotNull()).alias("failed"))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that every rule keeps, with their own columns."""
    # Not a filter: the optimiser would push it, with a copy of every count in it, below the projections.
    (whole,) = unused([*docs.columns, *COUNTS], "row")
    found = apply_rules(docs.select("text", F.struct(*(F.col(c) for c in docs.columns)).alias(whole)), rules)
    return found.select(F.inline(F.when(F.col("kept"), F.array(whole))))


def oracle() -> str:
    """The digest of ``op7_quality_rules`` in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    bounds = []
    for r in RULES:
        if r.low is not None:
            bounds.append(f"{r.part}::double >= {r.low}::double * {r.whole}::double")
        if r.high is not None:
            bounds.append(f"{r.part}::double <= {r.high}::double * {r.whole}::double")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {" AND ".join(bounds)}) AS kept FROM b"""
