"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions.

Counts are taken once for each text; every rule is a ratio of counts with a lowest and a highest value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """the of and to in a is that for it on was with as be at by from this are or an not you have
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya""".split()

SPACE = r"[ \t-\r]+"


@dataclass(frozen=True)
class Threshold:
    """kept only if low <= top / bottom <= high; no test where bottom is 0 or fewer than `least` words are there."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The method's own table; ratios are lenient, so that only texts far from prose fail.
TABLE = (
    Threshold("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Threshold("stop_words", "n_stop_words", "n_words", 0.01, None, 100),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9, 100),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5, 100),
)
#: Shares in percent that the contract fixes.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def _let(value: Column, use) -> Column:
    """use(value), where value is evaluated once even if lambda functions refer to it for every element."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words inside runs of WINDOW words that the text has twice or more. words is a lambda variable."""

    def places(runs: Column) -> Column:
        """Where runs begin that are found twice, in order."""
        tagged = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            tagged,
            lambda s: F.array_sort(
                F.filter(
                    F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
                    lambda x: x.isNotNull(),
                )
            ),
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + F.lit(WINDOW) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    # a run is compared by a 64-bit hash of its words' hashes, inside one text only
    runs = _let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    found = _let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), 0).otherwise(covered(places(r))))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found)


def counts(text: Column) -> Column:
    """A struct of the counts of one text; null counts as empty."""

    def of(text: Column, words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": F.aggregate(words, F.lit(0), lambda n, x: n + F.length(x)),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated(words),
            "n_stop_words": F.size(F.filter(words, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        }
        return F.struct(*[c.cast("bigint").alias(k) for k, c in found.items()])

    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return _let(words, lambda w: _let(lines, lambda n: of(text, w, n)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def verdict(count: dict[str, Column], table: tuple[Threshold, ...] = TABLE) -> Column:
    """The table as one condition over the counts."""
    out = F.lit(True)
    for t in table:
        ratio = count[t.top] / F.nullif(count[t.bottom], F.lit(0))
        ok = F.lit(True)
        if t.low is not None:
            ok = ok & (ratio >= t.low)
        if t.high is not None:
            ok = ok & (ratio <= t.high)
        out = out & F.when(count["n_words"] >= t.least, F.coalesce(ok, F.lit(True))).otherwise(True)
    return out


def assess(docs: DataFrame, table: tuple[Threshold, ...] = TABLE, text_col: str = "text") -> DataFrame:
    """(row, quality) for every row: all columns in `row`, the counts and decisions in `quality`.

    Null and empty texts have no words and fail the base rules. Repeated rows each come back.
    """
    counted = docs.select(F.struct("*").alias("row"), counts(F.col(f"`{text_col}`")).alias("c"))
    c = {k: F.col(f"c.{k}") for k in COUNTS}
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
    return counted.select("row", F.struct(*[x.alias(k) for k, x in c.items()], failed.alias("base_failed"), (~failed & verdict(c, table)).alias("kept")).alias("quality"))
