"""Quality rules: one table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the languages served, lower case.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "this", "have", "from", "by"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "im", "für", "auf", "sich", "ein", "eine", "als", "auch", "es", "an"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "est", "pour", "dans", "qui", "sur", "par", "au", "il", "pas"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "es", "por", "con", "para", "del", "se", "al", "lo", "no", "su"],
}
#: Letters of the script that those languages share, as a pattern's class.
LATIN = "A-Za-z\u00C0-\u024F"
#: A text's own words of at most SHORT characters that it repeats count as function words too, SHARE of them as one: so
#: any language's do, whether its words are listed or not.
SHORT, SHARE = 3, 3
#: rule, numerator, denominator, least and most of 100 * numerator / denominator, the words a text needs for the rule to
#: apply, and the percentage of Latin letters among its characters: stop words say nothing of a text in another script.
RULES: list[tuple[str, str, str, int | None, int | None, int, int]] = [
    ("word_length", "word_chars", "n_words", 150, 2500, 1, 0),
    ("symbols", "n_symbols", "word_chars", None, 10, 1, 0),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50, 1, 0),
    ("function_words", "n_function_words", "n_words", 2, None, 100, 50),
    ("words_per_line", "n_words", "n_lines", 150, None, 100, 0),
]


def measures(text: Column) -> list[tuple[str, Column]]:
    """Columns by name, each of which may use the ones before it."""
    words = F.col("_words")
    # of each window the hash of its words' hashes; the last WINDOW - 1 words begin none
    begins = F.slice("_hashes", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(begins, lambda h, i: F.xxhash64(h, *[F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]))
    at = F.col("_windows")
    placed = F.sort_array(F.transform(at, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size("_sorted")
    same = lambda i, j: F.get(F.col("_sorted"), i)["h"] == F.get(F.col("_sorted"), j)["h"]
    twice = F.filter(F.col("_sorted"), lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    low = F.col("_low")
    beside = lambda x, i, k: F.coalesce(F.get(F.col("_short"), i + k) == x, F.lit(False))
    repeated = F.size(F.filter("_short", lambda x, i: beside(x, i, -1) | beside(x, i, 1)))
    few = 100 * F.col("n_stop_words") < 2 * F.col("n_words")
    return [
        ("_text", F.coalesce(text, F.lit(""))),
        ("_words", F.array_remove(F.split("_text", f"[{SPACE}]+"), "")),
        ("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))),
        ("n_words", F.size("_words")),
        ("word_chars", F.length(F.translate("_text", " \t\n\x0b\x0c\r", ""))),
        ("n_symbols", F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))),
        ("n_lines", F.size("_lines")),
        ("n_dup_lines", F.size("_lines") - F.size(F.array_distinct("_lines"))),
        ("_low", F.split(F.lower("_text"), f"[{SPACE}]+")),
        ("n_stop_words", F.size(F.filter(low, lambda w: w.isin(stops)))),
        # only texts that lack the listed words need their own looked for
        ("_short", F.when(few, F.sort_array(F.filter(low, lambda w: (F.length(w) <= SHORT) & (w != "")))).otherwise(F.array().cast("array<string>"))),
        ("n_function_words", F.col("n_stop_words") + F.floor(repeated / SHARE).cast("int")),
        # the script is asked of texts that lack function words alone
        ("n_latin", F.when(100 * F.col("n_function_words") < 2 * F.col("n_words"), F.length(F.regexp_replace("_text", f"[^{LATIN}]+", ""))).otherwise(F.lit(0))),
        ("_hashes", F.transform(words, lambda w: F.xxhash64(w))),
        ("_windows", hashes),
        # most texts repeat no window: then nothing is sorted
        ("_sorted", F.when(F.size(F.array_distinct(at)) < F.size(at), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))),
        ("n_repeat_words", F.when(n > 0, covered).otherwise(F.lit(0))),
    ]


def verdict(rules: list[tuple] = RULES) -> Column:
    """True if no rule of the table is broken; a rule with denominator 0 or too few words doesn't apply."""
    good = F.lit(True)
    for _, over, under, least, most, words, latin in rules:
        fails = F.lit(False)
        if least is not None:
            fails = fails | (100 * F.col(over) < least * F.col(under))
        if most is not None:
            fails = fails | (100 * F.col(over) > most * F.col(under))
        script = (100 * F.col("n_latin") >= latin * F.col("word_chars")) if latin else F.lit(True)
        good = good & ~((F.col("n_words") >= words) & (F.col(under) > 0) & script & fails)
    return good


def apply_rules(docs: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """docs with the measures of `text`, base_failed and kept.

    One projection of built-in functions, no shuffle. A null or empty text has
    no words and fails the base; repeated rows each get the same verdict. Other
    columns stay, but columns with the names of the measures are replaced.
    """
    out = docs
    for name, value in measures(F.col(text)):
        out = out.withColumn(name, value)
    for name in ("n_words", "word_chars", "n_symbols", "n_latin", "n_lines", "n_dup_lines", "n_stop_words", "n_function_words", "n_repeat_words"):
        out = out.withColumn(name, F.col(name).cast("long"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", base)
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.drop("_text", "_words", "_lines", "_low", "_short", "_hashes", "_windows", "_sorted")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(*COLUMNS)


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = []
    for _, over, under, least, most, words, latin in RULES:
        parts = ([f"100 * {over} < {least} * {under}"] if least is not None else []) + ([f"100 * {over} > {most} * {under}"] if most is not None else [])
        tests.append(f"NOT (n_words >= {words} AND {under} > 0 AND {f'100 * n_latin >= {latin} * word_chars' if latin else 'TRUE'} AND ({' OR '.join(parts)}))")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, length(regexp_replace(t, '[^{LATIN}]', '', 'g')) AS n_latin,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars FROM d),
g AS (SELECT doc_id, i, ws[i:i+{WINDOW - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM m)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
w AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id),
v AS (SELECT m.doc_id, len(ws) AS n_words, word_chars, n_symbols, n_latin, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words, list_filter(list_transform(ws, lambda x: lower(x)), lambda x: length(x) <= {SHORT}) AS short,
    coalesce(w.n, 0) AS n_repeat_words FROM m LEFT JOIN w ON w.doc_id = m.doc_id),
f AS (SELECT *, n_stop_words + CASE WHEN 100 * n_stop_words < 2 * n_words THEN len(list_filter(short, lambda x: len(list_filter(short, lambda y: y = x)) > 1)) // {SHARE} ELSE 0 END AS n_function_words FROM v),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b"""


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL = {"op3_quality_rules": _sql()}
