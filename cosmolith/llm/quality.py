"""Operator 8: quality by weak supervision. Rules vote good or bad, or abstain; expectation-maximisation over the counts
of vote patterns estimates each rule's accuracy and the share of good documents; a document is kept by its posterior.

All of it is column expressions. What leaves the executors is one count for each vote pattern (at most 3 ** 8).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import WORD_GAP, table, written

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["short_lines", "word_length", "symbols", "capitals", "dup_lines", "punctuation", "repetition", "variety"]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows whose words are found at two or more places. Windows are compared by 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def _covered(hashes: Column) -> Column:
    """Size of the union of [i, i + 3) over the places i whose hash occurs again."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twin = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | (i > 0) & F.coalesce(F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))
    # `placed` is bound once, as the element of an array of one, so that it isn't sorted for every element.
    marked = F.flatten(F.transform(F.array(placed), lambda s: F.flatten(F.transform(twin(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return F.size(F.array_distinct(marked))


def _chars_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` with the base figures of each whole text (null: no words), n_lines, n_capitals, n_punct and n_distinct (words)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("_w", F.filter(F.split(t, WORD_GAP), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_w")).withColumn("_g", _repeat_words(F.col("_w"), F.col("n_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    return df.select(
        *keep,
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _chars_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(again, _covered(F.col("_g"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_n_lines"),
        _chars_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("_n_capitals"),
        _chars_of(t, "!?|*#").cast("long").alias("_n_punct"),
        F.size(F.array_distinct("_w")).cast("long").alias("_n_distinct"),
    )


def votes() -> dict[str, Column]:
    """1 votes good, 0 bad, null abstains. Rules that tell little about a document that passes them vote bad only."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    never = F.lit(False)

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    return {
        "short_lines": rule(never, (F.col("_n_lines") >= 5) & (F.col("n_words") < 3 * F.col("_n_lines"))),
        "word_length": rule(never, (c < 2 * n) | (c > 14 * n)),
        "symbols": rule(100 * F.col("n_symbols") <= 5 * n, 100 * F.col("n_symbols") > 25 * n),
        "capitals": rule(100 * F.col("_n_capitals") <= 15 * c, 100 * F.col("_n_capitals") > 40 * c),
        "dup_lines": rule(never, (F.col("_n_lines") > 1) & (100 * F.col("n_dup_lines") > 50 * F.col("_n_lines"))),
        "punctuation": rule(100 * F.col("_n_punct") <= 10 * n, 100 * F.col("_n_punct") > 30 * n),
        "repetition": rule(never, 100 * F.col("n_repeat_words") > 30 * n),
        "variety": rule(never, (F.col("n_words") >= 50) & (F.col("n_words") <= 5000) & (100 * F.col("_n_distinct") < 25 * n)),
    }


def fit_rules(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, each rule's (accuracy on good, accuracy on bad)) from counts of vote patterns.

    Accuracies start at 0.8 and carry a prior of Beta(8, 2), the share one of Beta(8, 2) too, in units of a thousandth of the
    documents: a rule is more often right than wrong unless the votes say otherwise, and none is ever certain. A rule that
    never votes stays where it starts.
    """
    k = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    good, acc = 0.8, [(0.8, 0.8)] * k
    prior = max(total, 1) / 1000
    for _ in range(rounds):
        post = [(p, n, posterior(p, good, acc)) for p, n in patterns]
        new = []
        for r in range(k):
            hit = [prior * 8, prior * 8]
            seen = [prior * 10, prior * 10]
            for p, n, q in post:
                if p[r] is not None:
                    for y, w in ((0, (1 - q) * n), (1, q * n)):
                        seen[y] += w
                        hit[y] += w * (p[r] == y)
            new.append(tuple(hit[y] / seen[y] for y in (1, 0)))
        share = (sum(n * q for _, n, q in post) + 8 * prior) / (total + 10 * prior)
        done = abs(share - good) + sum(abs(a - b) for x, y in zip(acc, new, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9
        good, acc = share, new
        if done:
            break
    return good, acc


def weights(good: float, acc: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log-odds of the prior, and those that each rule's good and bad vote adds."""
    return math.log(good / (1 - good)), [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in acc]


def posterior(pattern: tuple[int | None, ...], good: float, acc: list[tuple[float, float]]) -> float:
    base, each = weights(good, acc)
    odds = base + sum(0.0 if v is None else w[1 - v] for v, w in zip(pattern, each, strict=True))
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` with the base figures, base_failed, quality (the posterior) and kept.

    Null and empty texts have no words and fail the base; columns in `keep` that clash with a figure are replaced; rows
    are judged one by one, so repeated rows give repeated results; an empty table gives an empty result.
    """
    rule = votes()
    own = {*BASE, *RULES, "base_failed", "quality", "kept"}
    keep = [c for c in keep if c not in own]
    based = with_base(docs, keep).withColumns({f"_v_{r}": v for r, v in rule.items()})
    based, _ = written(based.drop("_n_lines", "_n_capitals", "_n_punct", "_n_distinct"), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # What fails the base is judged; the rules are fitted on the rest, where their verdict counts.
    counts = based.where(~failed).groupBy(*(f"_v_{r}" for r in rule)).count().collect()
    good, acc = fit_rules(sorted(((tuple(row[:-1]), row[-1]) for row in counts), key=str))
    base, each = weights(good, acc)
    odds = sum((F.when(F.col(f"_v_{r}") == 1, g).when(F.col(f"_v_{r}") == 0, b).otherwise(0.0) for r, (g, b) in zip(rule, each, strict=False)), F.lit(base))
    out = based.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select(*keep, *BASE, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with the columns of docs, whatever their names. Null and empty texts go; repeated rows are
    judged each, alike; texts may be of any length; an empty table gives an empty one."""
    rows = docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))  # as a struct, so that no name clashes
    return quality(rows, ["_row"]).where("kept").select("_row.*")
