"""Text statistics as column expressions: words, symbols, repeated lines and repeated word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shared import SPACES, WORD, text_or_empty

SYMBOL = r"[#*$%&|<>]"
WINDOW = 3


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that occurs twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; of the
    marked positions each covers the words up to the next mark, at most a window.
    """

    def of_sorted(s):
        twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        marks = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["p"]))
        covered = lambda m: F.aggregate(
            F.transform(m, lambda p, i: F.least(F.coalesce(F.get(m, i + 1) - p, F.lit(window)), F.lit(window))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )
        return let(marks, covered)

    def of_words(w):
        spots = F.sequence(F.lit(0), F.size(w) - window)
        hashed = F.transform(spots, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("p")))
        distinct = let(hashed, lambda h: F.when(F.size(F.array_distinct(F.transform(h, lambda x: x["h"]))) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(h), of_sorted)))
        return F.when(F.size(w) > window, distinct).otherwise(F.lit(0).cast("long"))

    return let(words, of_words)


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of every whole text (null: empty) beside the kept columns, all long."""
    text = text_or_empty()
    staged = docs.select(*keep, text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    per_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        repeated_words(w).alias("n_repeat_words"),
    )
    per_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    )
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    counted = staged.select(
        *keep,
        F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        count(SYMBOL).alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        count(r"[0-9]").alias("n_digits"),
        let(split_words(F.col("_text")), per_words).alias("_words"),
        let(lines, per_lines).alias("_lines"),
    )
    return counted.select(*[c for c in counted.columns if c not in ("_words", "_lines")], "_words.*", "_lines.*")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """The statistics that learned rules compare, over the columns of ``measures``."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "upper": _share("n_upper", "word_chars"),
        "marks": _share("n_marks", "n_words"),
        "digits": _share("n_digits", "word_chars"),
        "distinct": _share("n_distinct", "n_words"),
        "repeats": _share("n_repeat_words", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
    }


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> list[tuple[list[float], int]]:
    """Statistics and label of at most ``rows`` labelled texts, the first ids by hash.

    The id list is bounded by ``rows`` before it is broadcast; of repeated ids the
    smallest statistics count; rows without an id or a label teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known if where is None else known.where(where)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    listed = measures(picked, "doc_id", "label").select("doc_id", "label", F.array(*features().values()).alias("x"))
    found = listed.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    return [(list(r["x"]), r["label"]) for r in sorted(found, key=lambda r: r["doc_id"])]
