"""Quality rules as a learned decision list, in DataFrame functions only."""

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import cut_lineage, row_key, table, unlink

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Thresholds tried for a feature, conditions of a rule, rules of a list.
CUTS, MAX_CONDITIONS, MAX_RULES = 15, 3, 6
#: A pruned rule needs this share of bad documents, and this many of them.
MIN_PRECISION, MIN_BAD = 0.7, 5
#: Ratios that conditions are grown on, as expressions over the counts.
FEATURES = {
    "words": "n_words",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "capitals_share": "n_capitals / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / n_words",
    "digits_share": "n_digits / greatest(word_chars, 1)",
}


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> F.Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def _repeat_words() -> list[tuple[str, F.Column]]:
    """Columns, each over the ones before, that end in n_repeat_words.

    Windows are hashed in place. Only if two in the text are equal are they
    sorted with their positions; the words covered are then summed along the
    positions of the repeated windows.
    """
    word = lambda i: F.get("_words", i)
    grams = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)])
    )
    ranked = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(x, k):
        near = [F.get("_ranked", k - 1)["h"] == x["h"], F.get("_ranked", k + 1)["h"] == x["h"]]
        return F.when(F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False)), x["i"])

    places = F.array_sort(F.array_compact(F.transform("_ranked", again)))
    gaps = F.transform("_places", lambda p, k: F.coalesce(F.least(F.get("_places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return [
        ("_grams", F.when(F.col("n_words") > WINDOW, grams)),
        ("_repeats", F.size("_grams") > F.size(F.array_distinct("_grams"))),
        ("_ranked", F.when(F.col("_repeats"), ranked)),
        ("_places", F.when(F.col("_repeats"), places)),
        ("n_repeat_words", F.coalesce(F.when(F.col("_repeats"), F.aggregate(gaps, F.lit(0), lambda a, g: a + g)), F.lit(0)).cast("long")),
    ]


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks, n_digits, base_failed).

    Counts over whole texts; a null has none of anything. Rows stay as many as
    they are, repeated ones included.
    """
    out = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("_text"))
    has_word = lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0
    steps = [
        ("_words", F.filter(F.split("_text", SPACE), lambda w: w != "")),
        ("_lines", F.filter(F.split("_text", "\n"), has_word)),
        ("n_words", F.size("_words").cast("long")),
        ("word_chars", F.length(F.array_join("_words", "")).cast("long")),
        ("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long")),
        ("n_capitals", F.regexp_count("_text", F.lit("[A-Z]")).cast("long")),
        ("n_marks", F.regexp_count("_text", F.lit("[!?]")).cast("long")),
        ("n_digits", F.regexp_count("_text", F.lit("[0-9]")).cast("long")),
        ("n_lines", F.size("_lines").cast("long")),
        ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        *_repeat_words(),
        ("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))),
    ]
    for name, column in steps:
        out = out.withColumn(name, column)
    return out.select(
        "key", "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks",
        "n_digits", "base_failed",
    )


def with_features(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f: F.when(F.col("n_words") > 0, F.expr(e)).otherwise(0).cast("double") for f, e in FEATURES.items()})


def _matches(conditions) -> F.Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(bad, good, all_bad, all_good):
    """Information gain of a condition, by the bad rows it keeps."""
    if bad == 0 or all_bad == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def _best_condition(rows: DataFrame, cuts: dict) -> tuple[Condition | None, float]:
    """The condition with the largest gain over the rows still covered.

    Each feature's place among its thresholds is counted by label, in one
    aggregation; a row for each feature and place reaches the driver.
    """
    above = {f: sum(((F.col(f) > t).cast("int") for t in own), F.lit(0)) for f, own in cuts.items()}
    place = F.array(*[F.struct(F.lit(f).alias("feature"), n.alias("place")) for f, n in above.items()])
    spots = rows.select("bad", F.explode(place).alias("s")).groupBy("s.feature", "s.place")
    table_ = {}
    for r in spots.agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect():
        table_[r.feature, r.place] = (r.bad, r.n - r.bad)
    best, top = None, 0.0
    for feature, own in cuts.items():
        column = [table_.get((feature, k), (0, 0)) for k in range(len(own) + 1)]
        all_bad, all_good = (sum(c[k] for c in column) for k in (0, 1))
        low_bad = low_good = 0
        for k, threshold in enumerate(own):
            low_bad, low_good = low_bad + column[k][0], low_good + column[k][1]
            for above, bad, good in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                gain = _gain(bad, good, all_bad, all_good)
                if gain > top + 1e-9:
                    best, top = Condition(feature, above, threshold), gain
    return best, top


def _pruned(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The shortest beginning of the rule that is best on rows it was not grown on, with its bad and good rows."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _matches(rule[:k])
        sums += [F.sum(F.when(hit, F.col("bad"))).alias(f"b{k}"), F.sum(F.when(hit, 1 - F.col("bad"))).alias(f"g{k}")]
    r = rows.agg(*sums).first()
    score = {}
    for k in range(1, len(rule) + 1):
        bad, good = r[f"b{k}"] or 0, r[f"g{k}"] or 0
        score[k] = ((bad - good) / (bad + good + 2), bad, good)
    best = max(score, key=lambda k: (score[k][0], -k))
    return rule[:best], score[best][1], score[best][2]


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """A decision list of rules for bad documents; empty without labels of both kinds.

    labelled has the columns of with_features and bad (0 or 1). Sequential
    covering: a rule grows by the condition with most gain on two thirds of the
    rows that no rule before it covers, is pruned on the last third and kept if
    it is precise there. All statistics are over all labelled rows.
    """
    names = list(FEATURES)
    grow = F.pmod("key", F.lit(3)) != 0
    rows = cut_lineage(labelled.select(*names, "bad", grow.alias("grow")))
    steps = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    marks = rows.filter("bad = 1").agg(*[F.percentile_approx(f, steps).alias(f) for f in names]).first()
    every = rows.agg(*[F.percentile_approx(f, steps).alias(f) for f in names]).first()
    cuts = {f: sorted({*(marks[f] or ()), *(every[f] or ())}) for f in names}
    rules = []
    left = rows
    while any(cuts.values()) and len(rules) < MAX_RULES:
        rule, covered = [], left.filter("grow")
        while len(rule) < MAX_CONDITIONS:
            found, gain = _best_condition(covered, cuts)
            if found is None or gain < 1.0:
                break
            rule.append(found)
            covered = covered.filter(found.column())
        if not rule:
            break
        rule, bad, good = _pruned(left.filter("NOT grow"), rule)
        if bad < MIN_BAD or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule)
        left = left.filter(~_matches(rule))
    unlink(rows)
    return rules


def verdict(rules: list[list[Condition]]) -> tuple[F.Column, F.Column]:
    """(whether a document is kept, the number of the first rule that matches or null) as one expression each."""
    kept, which = None, None
    for k, rule in enumerate(rules):
        hit = _matches(rule)
        kept = F.when(hit, False) if kept is None else kept.when(hit, False)
        which = F.when(hit, k + 1) if which is None else which.when(hit, k + 1)
    if kept is None:
        return F.lit(True), F.lit(None).cast("int")
    return kept.otherwise(True), which


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The counts of every document, base_failed, rule and kept.

    labels (doc_id, quality) tell good (1) from bad (0) documents; other and null
    values are no label, repeated labels count as often as they occur. A
    document fails by the base rule or by the first learned rule that matches.
    """
    counted = cut_lineage(counts(docs, doc_id, text))
    full = with_features(counted)
    told = labels.select(F.col(doc_id).alias("id"), F.col(quality).alias("q")).filter("q IN (0, 1)")
    labelled = full.join(told, "id").withColumn("bad", (1 - F.col("q")).cast("int"))
    kept, rule = verdict(learn(labelled.filter("NOT base_failed")))
    return full.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & kept).drop(*FEATURES)


def op8_quality_rules(spark, sf_dir):
    """Counts and verdict of every document, the list learnt from the labels."""
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
