"""Quality rules by weak supervision, in DataFrame functions.

Each rule votes for good (1) or bad (-1) or abstains (0).  The votes of all
documents are counted by pattern (at most 3 to the number of rules), and
expectation-maximisation over these counts estimates how often each rule is
right on good and on bad documents, and how many documents are good.  The
posterior probability of a document's votes decides, so one failing rule
does not reject a document that the others speak for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import id_text
from tessera.session import checkpoint_dir

WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
KEEP_AT = 0.5
MAX_ROUNDS = 40
TOLERANCE = 1e-7
#: Where the fit starts and what it is held to: the share of good documents
#: and how often a vote is right on good and on bad ones.  A rule that
#: rarely finds bad documents is allowed; one that often hits good ones is not.
START = {"prior": 0.8, "good": 0.95, "bad": 0.5}
CLAMP = {"prior": (0.02, 0.98), "good": (0.6, 0.999), "bad": (0.02, 0.98)}

#: The word and symbol classes of the base counts.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: A plain word: letters and at most one mark after them.
PLAIN = r"^\p{L}+[.,;:?!]?$"


def _repeated_words(windows: Column, words: int) -> Column:
    """Words under the windows whose hash occurs twice or more: sort by
    hash, keep those equal to a neighbour, add up the steps between them."""
    size = F.size(windows)
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = F.arrays_zip(by_hash.alias("own"), F.slice(by_hash, 2, size).alias("after"),
                          F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), by_hash).alias("before"))
    again = F.filter(beside, lambda x: x["own"].isNotNull() & (
        x["own"]["h"].eqNullSafe(x["after"]["h"]) | x["own"]["h"].eqNullSafe(x["before"]["h"])))
    places = F.sort_array(F.transform(again, lambda x: x["own"]["i"]))
    steps = F.zip_with(places, F.slice(places, 2, size), lambda p, q: F.least(F.coalesce(q - p, F.lit(words)), F.lit(words)))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(size > F.size(F.array_distinct(windows)), covered).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id and the counts the rules need, one row per input row; ``window``
    is any number of words from 1."""
    if window < 1:
        raise ValueError("a window has at least one word")
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(
        "doc_id", F.array_remove(F.split("text", BLANKS, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[.?]([\x20\x09-\x0D]|$)")).cast("bigint").alias("n_stops"))
    rows = rows.select(
        "doc_id", "n_symbols", "n_upper", "n_stops",
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size(F.filter("words", lambda w: w.rlike(PLAIN))).cast("bigint").alias("n_plain"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    hashes, wide = F.col("hashes"), 1
    while wide < window:  # hashes of 2, 4, 8 words from those of half as many; the last two may overlap
        further = min(wide, window - wide)
        pair = F.zip_with(hashes, F.slice(hashes, further + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn("hashes", pair)
        wide += further
    rows = rows.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.col("n_words") - (window - 1), F.lit(0)).cast("int")))
    return rows.withColumn("n_repeat_words", _repeated_words(F.col("hashes"), window)).drop("hashes")


def rules() -> dict[str, Column]:
    """Votes in the columns of ``measures``."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    size = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    stops = F.col("n_stops") / words
    plain = F.col("n_plain") / words
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeated = F.col("n_repeat_words") / words

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "v_length": vote(F.col("n_words") >= 50, F.col("n_words") < LEAST_WORDS),
        "v_word_size": vote((size >= 3) & (size <= 9), (size < 2.5) | (size > 12)),
        "v_symbols": vote(symbols <= 0.02, symbols > 0.1),
        "v_plain": vote(plain >= 0.9, plain < 0.7),
        "v_upper": vote(upper <= 0.15, upper > 0.4),
        "v_stops": vote((stops > 0.02) & (stops < 0.4), (stops < 0.01) & (F.col("n_words") >= 30)),
        "v_lines": vote(F.col("n_dup_lines") == 0, lines > 0.3),
        "v_repeats": vote(repeated <= 0.1, repeated > 0.3),
    }


def _posterior(model: dict, names: list[str]) -> Column:
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for n in names:
        good, bad = model["good"][n], model["bad"][n]
        odds = odds + F.when(F.col(n) == 1, math.log(good / (1 - bad))).when(
            F.col(n) == -1, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _clamped(kind: str, part: float, whole: float, last: float) -> float:
    low, high = CLAMP[kind]
    return min(max(part / whole, low), high) if whole else last


def fit(patterns: DataFrame, names: list[str]) -> dict:
    """Expectation-maximisation over the vote patterns (columns ``names``
    and their count ``n``); a round is one aggregate over them."""
    model = {"prior": START["prior"], "good": dict.fromkeys(names, START["good"]),
             "bad": dict.fromkeys(names, START["bad"])}
    p, n = F.col("p"), F.col("n")
    sums = [F.sum(n).alias("all"), F.sum(n * p).alias("good")]
    for k, v in enumerate(names):
        voted = F.col(v) != 0
        sums += [F.sum(F.when(voted, n * p).otherwise(0)).alias(f"g{k}"), F.sum(F.when(F.col(v) == 1, n * p).otherwise(0)).alias(f"gr{k}"),
                 F.sum(F.when(voted, n * (1 - p)).otherwise(0)).alias(f"b{k}"),
                 F.sum(F.when(F.col(v) == -1, n * (1 - p)).otherwise(0)).alias(f"br{k}")]
    for _ in range(MAX_ROUNDS):
        s = patterns.withColumn("p", _posterior(model, names)).agg(*sums).first()
        if not s["all"]:
            return model
        new = {"prior": _clamped("prior", s["good"], s["all"], model["prior"]),
               "good": {v: _clamped("good", s[f"gr{k}"], s[f"g{k}"], model["good"][v]) for k, v in enumerate(names)},
               "bad": {v: _clamped("bad", s[f"br{k}"], s[f"b{k}"], model["bad"][v]) for k, v in enumerate(names)}}
        moved = max(abs(new["prior"] - model["prior"]), *(abs(new[c][v] - model[c][v]) for c in ("good", "bad") for v in names))
        model = new
        if moved < TOLERANCE:
            break
    return model


def judge(docs: DataFrame, window: int = WINDOW_WORDS, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality (posterior): one row per input row.

    Null and empty texts have no words and fail the base rule.  Texts with
    equal counts are judged alike; repeated rows count as often as they
    occur; null ids are kept and other columns ignored.  An empty table
    gives an empty result.  The texts are read once; the fit reads a
    checkpointed table of vote patterns."""
    checkpoint_dir(docs.sparkSession)
    votes = rules()
    names = list(votes)
    rows = measures(docs, window).withColumns(votes).checkpoint()
    patterns = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1).checkpoint()
    model = fit(patterns, names)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    quality = _posterior(model, names)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (quality >= keep_at)).alias("kept"), quality.alias("quality"))
