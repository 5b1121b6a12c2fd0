"""Expected against produced items: matching, case scores, suite rates and gates.

A case is one row with its expected and produced items as arrays, so best-match search is
a map over the row and only the numbers of a case ever reach a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import let, no_blank

# ---- fixed values: evaluation word list, weights and thresholds -----------------------------
EVAL_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it",
    "of", "on", "or", "that", "the", "their", "this", "to", "use", "with", "will", "we", "was",
    "were", "should", "can", "could", "would",
)
DATE = r"\b20\d{2}-\d{2}-\d{2}(?:\s+\d{2}:\d{2})?\b"
PLACEHOLDER = "^tbd"
WEIGHTS = {"decisions": 0.30, "actions": 0.40, "risks": 0.15, "context": 0.15}


@dataclass(frozen=True)
class Thresholds:
    """Every match and gate threshold in one replaceable place."""

    min_case_score: float = 0.70
    text_match: float = 0.52
    action_match: float = 0.55
    greedy_match: float = 0.45
    max_score_drop: float = 0.0
    min_precision: float = 0.8
    min_recall: float = 0.8


def eval_text(c: Column) -> Column:
    """Lower-case words and numbers joined by single spaces."""
    return T.spaced_key(F.coalesce(c, F.lit("")))


def eval_tokens(c: Column) -> Column:
    return T.token_set(F.coalesce(c, F.lit("")), "[a-z0-9]+", EVAL_STOP)


def token_recall(expected: Column, actual: Column) -> Column:
    """F06 over token sets: 1 when nothing is expected."""
    return T.recall(expected, actual)


def _best(scored: Column) -> Column:
    """First item of the highest positive score: struct(score, item), or score 0 and ''."""
    ranked = F.sort_array(
        F.transform(
            F.filter(scored, lambda s: s["score"] > 0),
            lambda s, i: F.struct((-s["score"]).alias("n"), i.alias("i"), s["item"].alias("item")),
        )
    )
    return let(
        F.get(ranked, F.lit(0)),
        lambda b: F.struct(
            F.coalesce(-b["n"], F.lit(0.0)).alias("score"),
            F.coalesce(b["item"], F.lit("")).alias("item"),
        ),
    )


def best_text_matches(expected: Column, actual: Column, threshold: float) -> Column:
    """Per expected text the best produced text by token recall."""

    def fold(cands: Column) -> Column:
        def one(e: Column) -> Column:
            return let(
                eval_tokens(e),
                lambda et: let(
                    _best(
                        F.transform(
                            cands,
                            lambda c: F.struct(token_recall(et, c["t"]).alias("score"), c["x"].alias("item")),
                        )
                    ),
                    lambda b: F.struct(
                        e.alias("expected"),
                        b["score"].alias("score"),
                        b["item"].alias("best"),
                        (F.round(b["score"], 4) >= threshold).alias("matched"),
                    ),
                ),
            )

        return F.transform(expected, one)

    return let(
        F.transform(actual, lambda x: F.struct(x.alias("x"), eval_tokens(x).alias("t"))), fold
    )


ACTION = "struct<owner:string,action:string,deadline:string>"


def parse_actions(c: Column) -> Column:
    """'owner~action~deadline' items as structs."""
    return F.transform(
        c,
        lambda s: let(
            F.split(s, "~"),
            lambda p: F.struct(
                F.get(p, F.lit(0)).alias("owner"),
                F.get(p, F.lit(1)).alias("action"),
                F.coalesce(F.get(p, F.lit(2)), F.lit("")).alias("deadline"),
            ).cast(ACTION),
        ),
    )


def action_text(a: Column) -> Column:
    return F.array_join(no_blank(F.array(a["owner"], a["action"], a["deadline"])), " ")


def dates(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(DATE), F.lit(0)))


def best_action_matches(expected: Column, actual: Column, threshold: float) -> Column:
    """0.75 text recall + 0.20 owner + 0.05 deadline, best produced action per expected."""

    def fold(cands: Column) -> Column:
        def one(e: Column) -> Column:
            def with_expected(x: Column) -> Column:
                def score(c: Column) -> Column:
                    owner = (x["owner"] == "") | (
                        (c["owner"] != "") & (c["owner"] == x["owner"])
                    ) | F.contains(c["norm"], x["owner"])
                    due = (F.size(x["dates"]) == 0) | F.arrays_overlap(x["dates"], c["dates"])
                    return (
                        F.lit(0.75) * token_recall(x["t"], c["t"])
                        + F.lit(0.20) * F.when(owner, 1.0).otherwise(0.0)
                        + F.lit(0.05) * F.when(due, 1.0).otherwise(0.0)
                    )

                scored = F.transform(
                    cands, lambda c: F.struct(score(c).alias("score"), c["text"].alias("item"))
                )
                return let(
                    _best(scored),
                    lambda b: F.struct(
                        e["action"].alias("expected"),
                        b["score"].alias("score"),
                        b["item"].alias("best"),
                        (b["score"] >= threshold).alias("matched"),
                    ),
                )

            return let(
                F.struct(
                    eval_text(e["owner"]).alias("owner"),
                    eval_tokens(e["action"]).alias("t"),
                    dates(e["deadline"]).alias("dates"),
                ),
                with_expected,
            )

        return F.transform(expected, one)

    packed = F.transform(
        actual,
        lambda a: let(
            action_text(a),
            lambda t: F.struct(
                t.alias("text"),
                eval_text(t).alias("norm"),
                eval_text(a["owner"]).alias("owner"),
                eval_tokens(t).alias("t"),
                dates(t).alias("dates"),
            ),
        ),
    )
    return let(packed, fold)


def recall_of(matches: Column) -> Column:
    """Matched share to 4 decimals, 1 when nothing was expected."""
    n = F.size(matches)
    hit = F.size(F.filter(matches, lambda m: m["matched"]))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(hit / n, 4))


def weighted_score(sections: dict[str, Column]) -> Column:
    """Weighted recall over the sections that expect something."""
    weight = sum((F.when(F.size(m) > 0, WEIGHTS[k]).otherwise(0.0) for k, m in sections.items()), F.lit(0.0))
    total = sum(
        (F.when(F.size(m) > 0, F.lit(WEIGHTS[k]) * recall_of(m)).otherwise(0.0) for k, m in sections.items()),
        F.lit(0.0),
    )
    return let(
        F.struct(weight.alias("w"), total.alias("t")),
        lambda s: F.when(s["w"] == 0, F.lit(1.0)).otherwise(F.round(s["t"] / s["w"], 4)),
    )


def evaluate_cases(cases: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Q05 per case: section recalls, score and pass flag.

    ``cases`` has arrays expected_* and actual_*; expected_context is matched to the
    summary texts in actual_context.
    """
    c = F.col
    out = cases.select(
        "case_id",
        best_text_matches(c("expected_decisions"), c("actual_decisions"), limits.text_match).alias("m_decisions"),
        best_action_matches(c("expected_actions"), c("actual_actions"), limits.action_match).alias("m_actions"),
        best_text_matches(c("expected_risks"), c("actual_risks"), limits.text_match).alias("m_risks"),
        best_text_matches(c("expected_context"), c("actual_context"), limits.text_match).alias("m_context"),
    )
    sections = {k: c(f"m_{k}") for k in WEIGHTS}
    out = out.select(
        "case_id",
        *[recall_of(m).alias(f"{k}_recall") for k, m in sections.items()],
        *[F.size(m).alias(f"{k}_total") for k, m in sections.items()],
        weighted_score(sections).alias("score"),
    )
    return out.withColumn("passed", c("score") >= limits.min_case_score)


def suite_rollup(results: DataFrame) -> DataFrame:
    """A21."""
    total, passed = F.count(F.lit(1)), F.count_if("passed")
    return results.agg(
        total.alias("total_cases"),
        passed.alias("passed_cases"),
        (total - passed).alias("failed_cases"),
        F.coalesce(F.round(F.avg("score"), 4), F.lit(1.0)).alias("average_score"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )


def gate_checks(before: DataFrame, after: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Q06: candidate against baseline, one row per case with eight checks."""
    b = before.select("case_id", *[F.col(x).alias(f"b_{x}") for x in before.columns if x != "case_id"])
    joined = after.join(b, "case_id")
    checks = {
        "output_generated": F.col("changed"),
        "score_meets_threshold": F.col("passed"),
        "overall_score_not_regressed": F.col("b_score") - F.col("score") <= limits.max_score_drop,
        **{
            f"{k}_recall_not_regressed": F.col(f"{k}_recall") >= F.col(f"b_{k}_recall")
            for k in WEIGHTS
        },
        "critic_passed": F.col("critic_passed"),
    }
    names = list(checks)
    out = joined.select(
        "case_id", F.col("b_score").alias("v1_score"), F.col("score").alias("v2_score"), *[checks[n].alias(n) for n in names]
    )
    failed = F.filter(
        F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]), lambda x: x.isNotNull()
    )
    return out.withColumn("failed_checks", failed).withColumn(
        "passed", F.size("failed_checks") == 0
    )


# ---- J08, A19: one-to-one greedy match ---------------------------------------------------------
def is_placeholder(c: Column) -> Column:
    return F.lower(T.squash(c)).rlike(J.ahead(PLACEHOLDER))


def norm(c: Column) -> Column:
    return F.lower(T.squash(c))


def greedy_pairs(expected: Column, actual: Column, threshold: float = 0.45) -> Column:
    """Expected in order; each takes the best unused produced action.

    Array of (e, a) positions from 0.  Ties go to the lowest position.
    """
    pair = "struct<e:int,a:int>"

    def fold(es: Column, acts: Column) -> Column:
        def step(used: Column, e: Column) -> Column:
            free = F.filter(
                acts, lambda a: ~F.exists(used, lambda u: u["a"] == a["i"])
            )
            scored = F.filter(
                F.transform(
                    free,
                    lambda a: F.struct((-similar(e, a)).alias("n"), a["i"].alias("i")),
                ),
                lambda s: -s["n"] > 0,
            )
            return let(
                F.get(F.sort_array(scored), F.lit(0)),
                lambda b: F.when(
                    b.isNotNull() & (-b["n"] >= threshold),
                    F.concat(used, F.array(F.struct(e["i"].alias("e"), b["i"].alias("a")).cast(pair))),
                ).otherwise(used),
            ).cast(f"array<{pair}>")

        return F.aggregate(es, F.array().cast(f"array<{pair}>"), step)

    def similar(e: Column, a: Column) -> Column:
        inside = F.contains(a["norm"], e["norm"]) | F.contains(e["norm"], a["norm"])
        return (
            F.when((e["norm"] == "") | (a["norm"] == ""), F.lit(0.0))
            .when(inside, F.lit(1.0))
            .otherwise(T.overlap(e["t"], a["t"]))
        )

    def pack(items: Column) -> Column:
        return F.transform(
            items,
            lambda x, i: F.struct(
                i.alias("i"),
                norm(x["action"]).alias("norm"),
                T.stripped_tokens(x["action"], L.SCORE_STOP).alias("t"),
            ),
        )

    return let(
        F.struct(pack(expected).alias("e"), pack(actual).alias("a")), lambda s: fold(s["e"], s["a"])
    )


def score_actions(cases: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Recall, and owner and deadline accuracy over evaluable matches (null when none)."""
    c = F.col
    real = F.filter("expected_actions", lambda e: ~is_placeholder(e["action"]))
    out = cases.select("case_id", real.alias("e"), c("actual_actions").alias("a"))
    out = out.withColumn("pairs", greedy_pairs(c("e"), c("a"), threshold))
    judged = F.transform(
        "pairs",
        lambda p: let(
            F.struct(F.get(c("e"), p["e"]).alias("e"), F.get(c("a"), p["a"]).alias("a")),
            lambda s: F.struct(
                evaluable(s["e"]["owner"], "unassigned").alias("owner_counts"),
                (norm(s["e"]["owner"]) == norm(s["a"]["owner"])).alias("owner_ok"),
                evaluable(s["e"]["deadline"], "no deadline stated").alias("due_counts"),
                (norm(s["e"]["deadline"]) == norm(s["a"]["deadline"])).alias("due_ok"),
            ),
        ),
    )
    out = out.withColumn("j", judged)

    def share(counts: str, ok: str) -> Column:
        total = F.size(F.filter("j", lambda x: x[counts]))
        good = F.size(F.filter("j", lambda x: x[counts] & x[ok]))
        return F.when(total > 0, F.round(good / total, 6))

    n = F.size("e")
    return out.select(
        "case_id",
        n.alias("expected_count"),
        F.size("pairs").alias("found_count"),
        F.when(n > 0, F.round(F.size("pairs") / n, 6)).otherwise(0.0).alias("recall"),
        share("owner_counts", "owner_ok").alias("owner_accuracy"),
        share("due_counts", "due_ok").alias("deadline_accuracy"),
    )


def evaluable(c: Column, none_word: str) -> Column:
    n = norm(c)
    return (n != "") & ~is_placeholder(c) & (n != none_word)


# ---- J09, A18, U02: exact normalized sets ---------------------------------------------------------
def exact_key(c: Column) -> Column:
    """F03, exact scorer dialect: the task sentence without bullets and owner labels."""
    return F.trim(C.apply(F.lower(F.trim(c)), C.EXACT_ACTION))


def key_sets(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, exact_key), lambda k: k != ""))


def exact_scores(cases: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Precision, recall and F1 with the empty-set rules, PASS or FAIL."""
    c = F.col
    out = cases.select("case_id", key_sets(c("expected_lines")).alias("e"), key_sets(c("actual_lines")).alias("a"))
    both = F.size(F.array_intersect("e", "a"))
    ne, na = F.size("e"), F.size("a")
    empty = (ne == 0) & (na == 0)
    precision = F.when(empty, 1.0).when(na > 0, both / na).otherwise(0.0)
    recall = F.when(empty, 1.0).when(ne > 0, both / ne).otherwise(1.0)
    out = out.withColumn("p", precision).withColumn("r", recall)
    f1 = (
        F.when(empty, 1.0)
        .when(c("p") + c("r") == 0, 0.0)
        .otherwise(2 * c("p") * c("r") / (c("p") + c("r")))
    )
    return out.select(
        "case_id",
        F.when((c("p") >= limits.min_precision) & (c("r") >= limits.min_recall), "PASS").otherwise("FAIL").alias("status"),
        ne.alias("expected_count"),
        na.alias("actual_count"),
        both.alias("matched_count"),
        F.size(F.array_except("e", "a")).alias("missing_count"),
        F.size(F.array_except("a", "e")).alias("unexpected_count"),
        F.round(c("p"), 4).alias("precision"),
        F.round(c("r"), 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
    )


def set_parts(cases: DataFrame) -> DataFrame:
    """Matched, missing and unexpected keys as rows."""
    c = F.col
    out = cases.select("case_id", key_sets(c("expected_lines")).alias("e"), key_sets(c("actual_lines")).alias("a"))

    def tag(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("part"), k.alias("key")))

    parts = F.concat(
        tag("matched", F.array_intersect("e", "a")),
        tag("missing", F.array_except("e", "a")),
        tag("unexpected", F.array_except("a", "e")),
    )
    out = out.select("case_id", F.explode_outer(parts).alias("p"))
    return out.filter(c("p").isNotNull()).select("case_id", "p.part", "p.key")


def full_outer_keys(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """J09 over item rows: the join key holds the text key, so a hot case is spread."""
    e = expected.select("case_id", exact_key(F.col("item")).alias("key")).filter("key <> ''").distinct()
    a = actual.select("case_id", exact_key(F.col("item")).alias("key")).filter("key <> ''").distinct()
    joined = e.withColumn("in_e", F.lit(True)).join(
        a.withColumn("in_a", F.lit(True)), ["case_id", "key"], "full"
    )
    return joined.groupBy("case_id").agg(
        F.count_if(F.col("in_e") & F.col("in_a")).alias("matched"),
        F.count_if(F.col("in_a").isNull()).alias("missing"),
        F.count_if(F.col("in_e").isNull()).alias("unexpected"),
    )


# ---- A17, A26, J13, P26 -------------------------------------------------------------------------
def coverage(actions: Column) -> list[Column]:
    """Owner and due-date coverage and the number of repeated tasks."""
    n = F.size(actions)
    owned = F.size(F.filter(actions, lambda a: F.coalesce(F.trim(a["owner"]), F.lit("")) != ""))
    dated = F.size(F.filter(actions, lambda a: F.coalesce(F.trim(a["due"]), F.lit("")) != ""))
    keys = F.filter(F.transform(actions, lambda a: T.spaced_key(a["task"])), lambda k: k != "")
    return [
        F.when(n > 0, F.round(owned / n, 6)).otherwise(0.0).alias("owner_coverage"),
        F.when(n > 0, F.round(dated / n, 6)).otherwise(0.0).alias("due_coverage"),
        (F.size(keys) - F.size(F.array_distinct(keys))).alias("duplicates"),
    ]


def select_cases(cases: DataFrame, wanted: DataFrame | None, has_text: Column) -> DataFrame:
    """Chosen cases with a transcript are run, the others are reported with a reason."""
    out = cases
    if wanted is not None:
        out = out.join(wanted.select("case_id").distinct().withColumn("chosen", F.lit(True)), "case_id", "left")
    else:
        out = out.withColumn("chosen", F.lit(True))
    reason = (
        F.when(F.col("chosen").isNull(), "not_selected")
        .when(F.col("ground_truth_status") != "complete", "ground_truth_incomplete")
        .when(~F.coalesce(has_text, F.lit(False)), "no_transcript")
        .otherwise("")
    )
    return out.select("case_id", reason.alias("reason"), (reason == "").alias("selected"))
