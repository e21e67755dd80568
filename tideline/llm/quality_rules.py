"""Quality rules: a threshold table compiled into one Spark projection.

Every figure is a built-in expression over the whole text; no shuffle, no
user function. The table below is the whole policy: a rule names a ratio,
its allowed range, and from how many words on it applies.

Defined results: null text counts as empty; a text without words has zero in
every count and fails the base rule; rows are judged one by one, so repeated
rows get equal results and an empty table gives an empty result. Columns
other than ``id_col`` and ``text_col`` are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, or_empty

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: fixed values: frequent function words of four languages
STOP_WORDS = {
    "en": "the of and to in is that for with on as was by at this from it be are a an or not have he she they",
    "de": "der die das und ist von mit den dem des ein eine einen nicht sich zu auf im für als auch es an in",
    "fr": "le la les de des du et un une en que qui dans pour par sur au est il elle ne pas plus ce se",
    "es": "el la los las de del y un una en que se por con para es no al lo su como más o a",
}


@dataclass(frozen=True)
class Rule:
    """``low <= ratio <= high`` must hold for texts of ``from_words`` words or more."""
    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    from_words: int = 1


#: the threshold table; ratios are SQL over the counts of ``measured``
RULES = (
    Rule("word_length", "word_chars / n_words", low=2.5, high=12.0),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.1),
    Rule("stop_word_share", "n_stop_words / n_words", low=0.04, from_words=20),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", high=0.4),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text: words, characters, symbols, lines, stop words and
    repeated windows. Each array is built once and used by the next projection.

    A window is identified by the 64-bit hash of its words.
    """
    stops = ", ".join("'" + w + "'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
    d = docs.select(F.col(id_col).alias("doc_id"), or_empty(text_col).alias("__t"))
    d = d.withColumn("__w", F.array_remove(F.split("__t", WORD_GAP), ""))
    d = d.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(__t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("__lines"),
        F.expr(f"size(filter(__w, w -> lower(rtrim('.,;:!?', w)) in ({stops})))").cast("long").alias("n_stop_words"),
        F.expr(f"case when size(__w) >= {WINDOW} then transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64("
               + ", ".join(f"__w[i + {k}]" for k in range(WINDOW)) + ")) else cast(array() as array<bigint>) end").alias("__g"),
    )
    # only texts with a repeated window pay for the sort
    d = d.withColumn("__s", F.expr(
        "case when size(array_distinct(__g)) < size(__g) then sort_array(transform(__g, (g, i) -> struct(g as g, i as i)))"
        " else cast(array() as array<struct<g:bigint,i:int>>) end"))
    d = d.withColumn("__p", F.expr(
        "sort_array(transform(filter(__s, (x, j) -> (j > 0 and __s[greatest(j - 1, 0)].g = x.g)"
        " or (j < size(__s) - 1 and __s[least(j + 1, size(__s) - 1)].g = x.g)), x -> x.i))"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_stop_words",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"aggregate(__p, named_struct('last', -{WINDOW}, 'n', 0L),"
               f" (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last))).n").alias("n_repeat_words"),
    )


def judged(counts: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 10,
           max_repeat_percent: int = 20) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` (names in table order) and ``kept``."""
    checks = []
    for r in rules:
        bad = [f"{r.ratio} < {r.low!r}D"] * (r.low is not None) + [f"{r.ratio} > {r.high!r}D"] * (r.high is not None)
        # a text without words, or without lines, has no ratio and breaks no ratio rule
        checks.append(f"case when n_words >= {max(1, r.from_words)} and n_lines > 0 and ({' or '.join(bad)}) then '{r.name}' end")
    return (counts
            .withColumn("base_failed", F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"))
            .withColumn("failed_rules", F.expr(f"array_compact(array({', '.join(checks)}))") if checks else F.expr("cast(array() as array<string>)"))
            .withColumn("kept", F.expr("not base_failed and size(failed_rules) = 0")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the counts, the broken rules and the verdict."""
    return judged(measured(docs, id_col, text_col), rules)
