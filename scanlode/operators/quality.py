"""Detection quality against labelled cases: confusion matrices, per-rule and per-confidence figures, budgets, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.domains import CONFIDENCES
from scanlode.plans.tables import placed


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def predictions(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """``cases(name, expected_rule, expect_finding)`` and ``findings(name, rule_id, confidence)``: adds predicted and strongest.

    A case with an expected rule is predicted by a finding of that rule, another by any.
    """
    hit = F.col("rule_id").isNotNull() & (F.col("expected_rule").isNull() | (F.col("rule_id") == F.col("expected_rule")))
    joined = cases.join(findings.select("name", "rule_id", "confidence"), "name", "left")
    best = F.min(F.when(hit, C.confidence_rank(F.col("confidence"))))
    out = joined.groupBy("name", "expected_rule", "expect_finding").agg(F.bool_or(hit).alias("predicted"), best.alias("_rank"))
    strongest = F.lit(None).cast("string")
    for c, i in CONFIDENCES.items():
        strongest = F.when(F.col("_rank") == i, c).otherwise(strongest)
    return out.withColumn("strongest", strongest).drop("_rank")


def _matrix() -> list[Column]:
    p, e = F.col("predicted"), F.col("expect_finding")
    return [F.count_if(x).alias(n) for n, x in (("tp", p & e), ("fp", p & ~e), ("tn", ~p & ~e), ("fn", ~p & e))]


def _rates(rows: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return rows.withColumns({"precision": precision, "recall": recall}).withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "accuracy": ratio(tp + tn, tp + fp + tn + fn), "false_positive_rate": ratio(fp, fp + tn)})


def overall(predicted: DataFrame) -> DataFrame:
    return _rates(predicted.agg(*_matrix()))


def by_rule(predicted: DataFrame) -> DataFrame:
    return _rates(predicted.where(F.col("expected_rule").isNotNull()).groupBy("expected_rule").agg(*_matrix()))


def by_confidence(predicted: DataFrame) -> DataFrame:
    """True and false positives and precision by a case's strongest confidence."""
    rows = predicted.where(F.col("strongest").isNotNull()).groupBy("strongest").agg(F.count_if("expect_finding").alias("tp"), F.count_if(~F.col("expect_finding")).alias("fp"))
    return rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def against_thresholds(rules: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rules with a threshold and whether precision and recall reach it."""
    t = thresholds.select("expected_rule", F.col("precision").alias("least_precision"), F.col("recall").alias("least_recall"))
    return rules.join(t, "expected_rule").withColumn("passed", (F.col("precision") >= F.col("least_precision")) & (F.col("recall") >= F.col("least_recall")))


def violations(now: DataFrame, before: DataFrame, budget: dict[str, float], key: str = "expected_rule") -> DataFrame:
    """Figures that fell (or, false positives, rose) by more than the budget since ``before``; rows that it lacks are skipped.

    A budget of 0 or less for ``confidence_precision`` skips that comparison.
    """
    metrics = [m for m in ("precision", "recall", "false_positive_rate") if m in now.columns and m in before.columns and m in budget]
    old = before.select(F.col(key).alias("_key"), *[F.col(m).alias(f"_{m}") for m in metrics])
    cells = []
    for m in metrics:
        drop = F.col(m) - F.col(f"_{m}") if m == "false_positive_rate" else F.col(f"_{m}") - F.col(m)
        cells.append(F.when(drop > budget[m], F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("before"), F.col(m).alias("now"))))
    rows = now.join(old, F.col(key) == F.col("_key")).select(F.col(key), F.explode(F.array_compact(F.array(*cells))).alias("x"))
    return rows.select(key, "x.metric", "x.before", "x.now")


def budget_violations(now: dict[str, DataFrame], before: dict[str, DataFrame], budget: dict[str, dict[str, float]]) -> DataFrame:
    """scope, name, metric, before, now of every figure beyond its scope's budget.

    Scopes are ``global`` (``overall``), ``rules`` (``by_rule``) and ``confidence`` (``by_confidence``); a scope that one side or the budget lacks
    is skipped, and so is a confidence budget of 0 or less.
    """
    keys = {"global": None, "rules": "expected_rule", "confidence": "strongest"}
    out = None
    for scope, key in keys.items():
        limits = {m: x for m, x in budget.get(scope, {}).items() if scope != "confidence" or x > 0}
        if scope not in now or scope not in before or not limits:
            continue
        a, b = now[scope], before[scope]
        if key is None:
            key, a, b = "_all", a.withColumn("_all", F.lit("all")), b.withColumn("_all", F.lit("all"))
        rows = violations(a, b, limits, key).select(F.lit(scope).alias("scope"), F.col(key).alias("name"), "metric", "before", "now")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a budget needs a scope that both sides have")
    return out


def timings(runs: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """runs, average, least, median, p95 and most; p95 is the element at round((n - 1) * 0.95), half to even.

    Order statistics come from the ranks of distinct values with their counts, which are totals
    over range partitions: neither a group nor a value that many share is in one task.
    """
    keys = list(by)
    counted = runs.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    rows = placed(counted, keys, "_v", "_c")
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("runs"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("average"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    of = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "runs", "average", "least", "most")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_t{i}"))
    last = F.col("runs") - 1

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("_rank") <= i) & (i < F.col("_rank") + F.col("_c")), F.col("_v")))

    joined = rows.join(F.broadcast(of) if not keys else of, same)  # one row without keys
    out = joined.groupBy(*keys, "runs", "average", "least", "most").agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"), at(F.bround(last * 0.95, 0)).alias("p95"))
    return out.select(*keys, "runs", "average", "least", "median", "p95", "most")
