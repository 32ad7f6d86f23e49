"""Quality rules: a table of thresholds compiled into one projection of Spark expressions, without user functions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Frequent words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "a and are as at be for from he in is it of on or that the this to was with "
    "auf das den der des die ein eine ich im in ist mit nicht sie und von zu "
    "au de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "con de del el en es la las lo los no por que se su un una y"
).split()


@dataclass(frozen=True)
class Threshold:
    """`low <= ratio <= high` wherever the text has at least `from_words` words. `ratio` is a measure, or one measure over another."""

    ratio: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 1


#: measure names are those of `measures`; "x/y" divides.
THRESHOLDS = (
    Threshold("word_chars/n_words", 2.0, 15.0, 10),
    Threshold("n_symbols/n_words", high=0.1),
    Threshold("n_shouts/n_words", high=0.3),
    Threshold("n_stop_words/n_words", low=0.02, from_words=40),
    Threshold("n_same_words/n_words", high=0.3, from_words=10),
    Threshold("n_dup_lines/n_lines", high=0.3),
)


def measures(text: Column) -> dict[str, Column]:
    """Counts of a whole text (null: empty) by name, as longs. The words are split once."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        plain = F.lower(F.regexp_replace(F.array_join(w, " "), r"[^\p{L}\p{N} ]", ""))
        return F.struct(
            F.size(w).alias("n_words"),
            _repeated(w).alias("n_repeat_words"),
            F.size(F.filter(F.split(plain, " "), lambda x: x.isin(STOP_WORDS))).alias("n_stop_words"),
            F.size(F.filter(w, lambda x, k: F.coalesce(x == F.get(w, k - 1), F.lit(False)))).alias("n_same_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD))), of_lines)
    counts = {
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_shouts": F.length(text) - F.length(F.translate(text, "!", "")),
    }
    return counts | {k: ("_words", words) for k in ("n_words", "n_repeat_words", "n_stop_words", "n_same_words")} | {k: ("_lines", lines) for k in ("n_lines", "n_dup_lines")}


def _repeated(w: Column, window: int = 5) -> Column:
    """Words in windows of `window` words that stand twice or more among the words `w`.

    Windows are told apart by their 64-bit hash. Sorted by hash, equal ones are neighbours; what they cover is summed over their places.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - window),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("at")))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["at"]))

    covered = let(let(F.sort_array(hashes), places), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(w) < window, 0).otherwise(covered)


def failures(thresholds: tuple[Threshold, ...]) -> Column:
    """Ratios of the table that are out of bounds, as an array, over columns named like the measures."""

    def ratio(name: str) -> Column:
        over, _, under = name.partition("/")
        return F.col(over) / F.when(F.col(under) > 0, F.col(under)) if under else F.col(over).cast("double")

    broken = [
        F.when((F.col("n_words") >= t.from_words) & ~F.coalesce(ratio(t.ratio).between(t.low, t.high), F.lit(True)), F.lit(t.ratio)) for t in thresholds
    ]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, the measures, base_failed, kept and failed_rules (names of the broken thresholds).

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. Null, empty and blank texts have
    measures 0 and fail the base. A ratio over 0 breaks nothing. Repeated rows are judged each; other columns are left out.
    """
    found = measures(F.col("_text"))
    shared = {v[0]: v[1] for v in found.values() if isinstance(v, tuple)}
    counted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select(
        "_id", *[v.cast("long").alias(k) for k, v in found.items() if not isinstance(v, tuple)], *[v.alias(k) for k, v in shared.items()])
    flat = counted.select("_id", *[(F.col(f"{v[0]}.{k}") if isinstance(v, tuple) else F.col(k)).cast("long").alias(k) for k, v in found.items()])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return flat.withColumn("base_failed", base).withColumn("failed_rules", failures(thresholds)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).withColumnRenamed("_id", id_col)
