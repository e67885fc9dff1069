"""Text statistics and a learned decision list, in Spark SQL expressions only.

The list is learned by sequential covering: grow a conjunction of thresholds on labelled statistics
that covers many low-quality and few high-quality rows, prune conditions that do not help on rows
kept aside, take it as the next rule, drop what it covers, and go on until no rule is good enough.
The rules become one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "lines_per_word", "stops_per_word")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``stats`` (struct): the counts that rules stand on. Words are runs other than space and 09-0D; null text has none.

    Everything is computed within the row, from arrays that are sorted rather than compared pairwise,
    so a text of any length takes n log n time and nothing is shuffled. Windows of equal hashes count
    as repeated if their words are equal too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    a = docs.select("*", words.alias("_w"), lines.alias("_l"), text.alias("_t"))
    n = F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select("*", n.cast("long").alias("_n"), windows.alias("_h"))
    # hash and place, so that equal windows come to stand together; only where any are equal
    c = b.select("*", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_any"))
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = c.select("*", F.sort_array(F.when(F.col("_any"), placed).otherwise(F.slice(placed, 1, 0))).alias("_s"))

    def same(x: Column, y: Column) -> Column:
        words = [F.get("_w", x["i"] + k) == F.get("_w", y["i"] + k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & words[0] & words[1] & words[2], F.lit(False))

    twice = F.transform("_s", lambda x, i: F.when(same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1)), x["i"]))
    e = d.select("*", F.sort_array(F.filter(twice, lambda p: p.isNotNull())).alias("_p"))
    covered = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"), p.alias("last")), lambda s: s["sum"])
    stats = F.struct(
        F.col("_n").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size(F.split("_t", "[.!?]", -1)) - 1).cast("long").alias("n_stops"),
    )
    # not deterministic to the optimizer, which else pushes filters on stats down and computes the arrays once an element
    whole = F.when(F.monotonically_increasing_id() >= 0, stats)
    return e.select(*[F.col(x) for x in docs.columns], whole.alias("stats"))


def features(stats: Column) -> dict[str, Column]:
    """What the learned conditions compare; shares of words or lines, 0 where there are none."""
    n = F.greatest(stats["n_words"], F.lit(1))
    return {
        "n_words": stats["n_words"].cast("double"),
        "mean_word": stats["word_chars"] / n,
        "symbols_per_word": stats["n_symbols"] / n,
        "dup_line_share": stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)),
        "repeat_share": stats["n_repeat_words"] / n,
        "lines_per_word": stats["n_lines"] / n,
        "stops_per_word": stats["n_stops"] / n,
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass
class DecisionList:
    """Rules in order; each a conjunction of (feature, ">" or "<=", threshold) that rejects. What no rule covers is kept."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self, values: dict[str, Column]) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            fits = reduce(lambda a, b: a & b, [values[f] > t if op == ">" else values[f] <= t for f, op, t in rule])
            out = F.when(fits, F.lit(True)).otherwise(out)
        return out


def _covers(rule: list[tuple[str, str, float]], row: dict) -> bool:
    return all(row[f] > t if op == ">" else row[f] <= t for f, op, t in rule)


def _worth(rule: list, rows: list[dict]) -> tuple[float, int, int]:
    bad = sum(1 for r in rows if r["bad"] and _covers(rule, r))
    good = sum(1 for r in rows if not r["bad"] and _covers(rule, r))
    return (bad - good) / max(1, bad + good), bad, good


def learn(rows: list[dict], max_rules: int = 8, max_conditions: int = 3, cuts: int = 32, precision: float = 0.95, support: int = 5) -> DecisionList:
    """Sequential covering over rows of features and ``bad``; every third row is kept aside for pruning and acceptance."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    found = DecisionList()
    while len(found.rules) < max_rules and any(r["bad"] for r in grow):
        rule: list[tuple[str, str, float]] = []
        inside = grow
        while len(rule) < max_conditions and any(not r["bad"] for r in inside):
            best = None
            total_bad = sum(r["bad"] for r in inside)
            rate = total_bad / len(inside)
            for f in FEATURES:
                order = sorted((r[f], r["bad"]) for r in inside)
                step = max(1, len(order) // (8 * cuts))
                bad_below = 0
                for i, (v, is_bad) in enumerate(order[:-1], 1):
                    bad_below += is_bad
                    if i % step and i > cuts and len(order) - i > cuts or order[i][0] == v:
                        continue
                    t = (v + order[i][0]) / 2
                    for op, bad, n in (("<=", bad_below, i), (">", total_bad - bad_below, len(order) - i)):
                        gain = bad * (bad / n - rate)  # bad rows covered times the rise in precision
                        if bad >= support and (best is None or gain > best[0]):
                            best = (gain, (f, op, t))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            inside = [r for r in inside if _covers([best[1]], r)]
        while len(rule) > 1:  # a condition goes if rows kept aside are covered as well without it
            worth = _worth(rule, prune)[0]
            shorter = max(([c for c in rule if c is not d] for d in rule), key=lambda x: _worth(x, prune)[0])
            if _worth(shorter, prune)[0] < worth:
                break
            rule = shorter
        _, bad, good = _worth(rule, prune + grow) if rule else (0, 0, 1)
        _, bad_p, good_p = _worth(rule, prune) if rule else (0, 0, 1)
        if not rule or bad < precision * (bad + good) or bad_p < precision * (bad_p + good_p) or bad < support:
            break
        found.rules.append(rule)
        grow, prune = ([r for r in part if not _covers(rule, r)] for part in (grow, prune))
    return found


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn from at most ``max_labelled`` rows, the first by a hash of their ids (the documented bound).

    Only a label's own statistics reach the driver: eight numbers a row; the bound holds after the
    join too, where ids may repeat. Rows that the base rules already reject, and labels that are
    null, do not count. Without labels the list is empty.
    """
    first = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id", "_quality").limit(max_labelled)
    chosen = first(labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("_quality")))
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).where(~base_failed(F.col("stats")))
    got = first(rows.select("doc_id", "_quality", F.when(F.col("_quality") == 0, 1).otherwise(0).alias("bad"), *[v.alias(k) for k, v in features(F.col("stats")).items()])).drop("_quality").collect()
    return learn([r.asDict() for r in sorted(got, key=lambda r: (hash(r.doc_id * 0x9E3779B97F4A7C15 & 0xFFFFFFFF), r.doc_id, r.bad))])


def assess(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept``. Clashing columns are replaced; each row is judged by itself, so repeated rows agree.

    A null or empty text has no words and fails the base rules; an empty table gives no rows.
    """
    plain = docs.drop("stats", "base_failed", "kept")
    failed = base_failed(F.col("stats"))
    return statistics(plain).withColumns({"base_failed": failed, "kept": ~failed & ~rules.rejects(features(F.col("stats")))})
