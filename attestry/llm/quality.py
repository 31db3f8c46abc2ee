"""Quality rules: a table of thresholds compiled into one projection over one row's text, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
#: The commonest function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    """the of and to in is that it for was with as on be by at this are from or an not
    le la les de des du un une et est en que qui pour dans sur pas par au avec
    der die das und ist den von zu mit im ein eine nicht auf dem sich des für auch
    el los las y por con para una del se no es su al lo como""".split()
)
#: As they count: small, with a capital, in capitals.
STOP_FORMS = tuple(sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}))


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; where the document has fewer than ``from_words`` words it passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Documents outside any of these are rejected; the floors for words and repeats are the base rules. Of about 20,000
#: documents labelled good (sf0.1 and check_s, 20 words or more) none has over a third of duplicate lines (two equal lines of
#: three are common), under 0.04 of stop words or under 0.49 of distinct words; the median of those labelled low has 0.01 of
#: stop words, and one in twenty under 0.02 of distinct words, which fall in long texts by themselves.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("alphabetic", "alpha_words_ratio", 0.6, None),
    Rule("capitals", "upper_ratio", None, 0.4),
    Rule("exclamations", "exclamations_per_word", None, 0.4),
    Rule("duplicate_lines", "dup_lines_ratio", None, 0.4),
    Rule("stop_words", "stop_words_ratio", 0.03, None, 40),
    Rule("words_variety", "distinct_words_ratio", 0.05, None),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), "")


def repeated_window_words(words: Column, window: int = 8) -> Column:
    """Words in windows of ``window`` words that the text has twice or more, the first included.

    Windows are hashed; only a text with equal hashes has its windows compared as strings.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    # (string, position) sorted: equal windows are neighbours
    strings = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (window - 1)),
            lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("w"), i.alias("i")),
        )
    )
    places = _let(
        strings,
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["w"] == x["w"])),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    differ = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).when(differ, F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the counts that the rules are made of; needs no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    out = docs.withColumn("_words", words_of(F.col(text_col))).withColumn("_lines", lines)
    n = F.size("_words").cast("long")
    return (
        out.withColumns(
            {
                "n_words": n,
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
                "n_lines_with_words": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeated_window_words(F.col("_words")),
                "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
                "n_letters": F.regexp_count(text, F.lit("\\p{L}")).cast("long"),
                "n_exclamations": F.regexp_count(text, F.lit("!")).cast("long"),
                "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
                "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*STOP_FORMS))).cast("long"),
                "n_alpha_words": F.size(F.filter("_words", lambda w: w.rlike("\\p{L}"))).cast("long"),
            }
        )
        .drop("_words", "_lines")
    )


def _metric(name: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "alpha_words_ratio": F.col("n_alpha_words") / words,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "exclamations_per_word": F.col("n_exclamations") / words,
        "dup_lines_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines_with_words"), F.lit(1)),
        "stop_words_ratio": F.col("n_stop_words") / words,
        "distinct_words_ratio": F.col("n_distinct_words") / words,
    }[name]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column for each rule, true where it is met."""
    out = {}
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (_metric(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (_metric(r.metric) <= r.high)
        out[r.name] = (F.col("n_words") < r.from_words) | ok
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and failed_rules.

    base_failed: fewer than min_words words, or over max_repeat_percent % of the words in repeated windows of 8 words.
    kept: neither that nor any rule failed. A null or empty text has no words and so isn't kept. Every row is judged by
    its own text alone: repeated rows get equal results, null ids stay, an empty table gives no rows. Other columns stay as
    they are; columns of ``docs`` with one of the added names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    helpers = ["n_lines_with_words", "n_upper", "n_letters", "n_exclamations", "n_distinct_words", "n_stop_words", "n_alpha_words"]
    own = [c for c in docs.columns if c not in {*added, "base_failed", "kept", "failed_rules"} or c == text_col]
    held = F.struct(*[F.col(c) for c in docs.columns])
    measured = measures(docs.select(held.alias("_row"), F.col(text_col).alias("_text")), "_text")
    # a generator of one row: filters on the verdict don't move below it, where they'd repeat every measure
    own_measures = F.struct(*[F.col(c) for c in (*added, *helpers)])
    measured = measured.select("_row", F.explode(F.array(own_measures)).alias("_m")).select("_row", "_m.*")
    checks = compile_rules(rules)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.select(
        *[F.col("_row")[c].alias(c) for c in own],
        *added,
        base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"),
        failed.alias("failed_rules"),
    )
