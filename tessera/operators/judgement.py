"""Judgements on screens: panels, calibration of gates, folds, audits, councils, admission of evidence, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import finite
from .graph import materialise
from .ranks import cumulative
from .sizes import small
from .stats import wilson

LOWER, HIGHER, MIXED = "LOWER_STRONGER", "HIGHER_STRONGER", "MIXED"


def canonical_best(scores: DataFrame, engine: str, parent: str, score: str, direction: str) -> DataFrame:
    """engine, parent, best: the strongest finite score, turned so that less is stronger; direction, MIXED per engine if
    its rows disagree. Aggregates with partial results; the heading of an engine is one row."""
    rows = scores.filter(finite(F.col(score)))
    best = F.min(F.when(F.col(direction) == HIGHER, -F.col(score)).otherwise(F.col(score))).alias("best")
    per = rows.groupBy(engine, parent).agg(best, F.min(direction).alias("__lo"), F.max(direction).alias("__hi"))
    heading = per.groupBy(engine).agg(F.max(engine).alias("__e"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    heading = heading.select("__e", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(MIXED).alias("direction"))
    return per.select(engine, parent, "best").join(F.broadcast(heading), F.col(engine) == F.col("__e")).drop("__e")  # one row an engine


def panel_separation(scores: DataFrame, panel: DataFrame, engine: str, parent: str, score: str, direction: str, active: str) -> DataFrame:
    """Per engine: direction, actives, inactives, best, median and worst active, best inactive, and how many inactives score
    at least as strongly as the best active, and actives no stronger than the best inactive.

    Numbers are in the engine's own units. An engine whose rows disagree on their direction has counts only.
    """
    members = small(panel.select(parent, active))
    rows = canonical_best(scores.join(members, parent), engine, parent, score, direction).join(members, parent)
    yes, v = F.col(active), F.col("best")
    ends = rows.groupBy(engine, "direction").agg(
        F.count_if(yes).alias("actives"), F.count_if(~yes).alias("inactives"), F.min(F.when(yes, v)).alias("ba"), F.median(F.when(yes, v)).alias("ma"),
        F.max(F.when(yes, v)).alias("wa"), F.min(F.when(~yes, v)).alias("bi"),
    )
    counts = rows.join(F.broadcast(ends.select(F.col(engine).alias("__e"), "ba", "bi")), F.col(engine) == F.col("__e")).groupBy("__e").agg(F.count_if(~yes & (v <= F.col("ba"))).alias("above"), F.count_if(yes & (v >= F.col("bi"))).alias("below"))
    known = F.col("direction") != MIXED
    shown = lambda c: F.when(known, F.when(F.col("direction") == HIGHER, -F.col(c)).otherwise(F.col(c)))
    return ends.join(counts, F.col(engine) == F.col("__e")).select(
        engine, "direction", "actives", "inactives", shown("ba").alias("best_active"), shown("ma").alias("median_active"), shown("wa").alias("worst_active"), shown("bi").alias("best_inactive"),
        F.when(known, F.col("above")).alias("inactives_above_best_active"), F.when(known, F.col("below")).alias("actives_below_best_inactive"),
    )


def panel_enrichment(scores: DataFrame, panel: DataFrame, engine: str, parent: str, score: str, direction: str) -> DataFrame:
    """engine, parent, percentile: the share of an engine's molecules, best pose each, that score at least as strongly.

    Each molecule's best pose is written once. Equal ones are counted, and running counts of the values, dealt into ranges
    if they are many, are looked up by the members: no molecule is compared with a member.
    """
    best = materialise(canonical_best(scores, engine, parent, score, direction).filter(F.col("direction") != MIXED).select(engine, parent, "best"), "best")
    total = best.groupBy(engine).agg(F.max(engine).alias("__t"), F.count(F.lit(1)).alias("__n")).drop(engine)
    values = best.groupBy(engine, "best").agg(F.count(F.lit(1)).alias("c"))
    up_to = cumulative(values, "best", ["c"], [engine]).select(F.col(engine).alias("__e"), F.col("best").alias("__v"), (F.col("before_c") + F.col("c")).alias("__k"))
    members = best.join(small(panel.select(parent)), parent, "left_semi")
    placed = members.join(up_to, (F.col(engine) == F.col("__e")) & (F.col("best") == F.col("__v"))).join(F.broadcast(total), F.col(engine) == F.col("__t"))  # one row an engine
    return placed.select(engine, parent, (F.col("__k") / F.col("__n")).alias("percentile"))


def tier_losses(panel: DataFrame, rejects: DataFrame, tiers: Sequence[str], key: str, active: str) -> DataFrame:
    """tier_no, tier, lost_actives, lost_inactives, deletes_actives: panel members by the first tier that rejects them.

    ``rejects`` has key and tier. Tiers without losses count zero.
    """
    number = F.create_map(*[x for i, t in enumerate(tiers) for x in (F.lit(t), F.lit(i))])
    first = rejects.groupBy(key).agg(F.min(number[F.col("tier")]).alias("tier_no"))
    lost = panel.join(first, key).groupBy("tier_no").agg(F.count_if(F.col(active)).alias("a"), F.count_if(~F.col(active)).alias("i"))
    names = panel.sparkSession.createDataFrame(list(enumerate(tiers)), "tier_no int, tier string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return names.join(lost, "tier_no", "left").select("tier_no", "tier", zero("a").alias("lost_actives"), zero("i").alias("lost_inactives"), (zero("a") > 0).alias("deletes_actives"))


def gate_calibration(panel: DataFrame, rejects: DataFrame, screened: DataFrame, key: str, active: str, required_recall: float) -> DataFrame:
    """members, actives, absent, recall, admissible, refusal for a panel that went through a funnel.

    Recall is the share of actives that no tier rejected; members that were never screened make it unknown, as a name that
    matches nothing would count as a survivor. Admissible: recall is known and at least what is required.
    """
    if not 0 < required_recall <= 1:
        raise ValueError("required_recall must be in (0, 1]")
    seen = screened.select(key).distinct().withColumn("__seen", F.lit(True))
    gone = rejects.select(key).distinct().withColumn("__gone", F.lit(True))
    rows = panel.join(seen, key, "left").join(gone, key, "left")
    out = rows.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(active)).alias("actives"), F.count_if(F.col("__seen").isNull()).alias("absent"), F.count_if(F.col(active) & F.col("__gone").isNull()).alias("k"))
    recall = F.when((F.col("absent") == 0) & (F.col("actives") > 0), F.col("k") / F.col("actives"))
    refusal = F.when(F.col("absent") > 0, "PANEL_NOT_SCREENED").when(F.col("actives") == 0, "NO_ACTIVES").when(F.col("recall") < required_recall, "RECALL_BELOW_REQUIRED")
    return out.withColumn("recall", recall).withColumn("refusal", refusal).select("members", "actives", "absent", "recall", F.col("refusal").isNull().alias("admissible"), "refusal")


def change_of_auc(before: DataFrame, after: DataFrame, least_positives: int = 10) -> DataFrame:
    """delta, bound, verdict of two one-row AUC frames over the same panel.

    The bound is the sum of both standard errors. Too few positives: UNDERPOWERED; a fall of at least the bound: WORSE; a
    rise that reaches it: ACCEPTED; anything between: WITHIN_NOISE.
    """
    both = before.select(F.col("positives").alias("p"), F.col("negatives").alias("n"), F.col("auc").alias("a0"), F.col("se").alias("s0")).crossJoin(after.select(F.col("positives").alias("p1"), F.col("negatives").alias("n1"), F.col("auc").alias("a1"), F.col("se").alias("s1")))  # one row each
    delta, bound = F.col("a1") - F.col("a0"), F.col("s0") + F.col("s1")
    verdict = (
        F.when((F.col("p") != F.col("p1")) | (F.col("n") != F.col("n1")), F.raise_error(F.lit("before and after are not of one panel")))
        .when(F.col("p") < least_positives, "UNDERPOWERED").when((delta < 0) & (delta <= -bound), "WORSE").when((delta <= 0) | (delta < bound), "WITHIN_NOISE").otherwise("ACCEPTED")
    )
    return both.select(delta.alias("delta"), bound.alias("bound"), verdict.alias("verdict"))


def group_fold(group: Column, folds: int, seed: str) -> Column:
    """A fold in 0..folds-1 that all rows of a group share."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def cross_fit(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Adds predicted: y by a line on x that is fitted on all rows of other folds.

    A fold's line comes from the totals of five sums less the fold's own: one aggregate, no row meets another. Null where
    the others don't determine a line.
    """
    sums = ["n", "sx", "sy", "sxx", "sxy"]
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    per = known.groupBy(F.col(fold).alias("__f")).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    rest = per.crossJoin(F.broadcast(total)).select("__f", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in sums])  # total: one row
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.abs(spread) > 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    lines = rest.withColumn("__b", slope).select("__f", "__b", ((F.col("sy") - F.col("__b") * F.col("sx")) / F.col("n")).alias("__a"))
    return df.join(F.broadcast(lines), F.col(fold) == F.col("__f"), "left").withColumn("predicted", F.col("__a") + F.col("__b") * a).drop("__f", "__a", "__b")  # a row a fold


def generator_audit(yields: DataFrame, model: str, stages: Sequence[str]) -> DataFrame:
    """stage_no, stage, left_model, right_model, left_rate, right_rate, decidable for all pairs of models.

    ``yields`` has model, stage, hits, trials: one row a model and stage; a missing one is an error, as a gap is not a zero.
    A pair is decidable where the Wilson intervals don't meet.
    """
    number = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    low, high = wilson(F.col("hits"), F.col("trials"))
    rows = yields.select(F.col(model).alias("m"), "stage", number[F.col("stage")].alias("stage_no"), (F.col("hits") / F.col("trials")).alias("rate"), low.alias("low"), high.alias("high")).filter("stage_no is not null")
    whole = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("m")))
    rows = whole.withColumn("rate", F.when(F.col("__n") == len(stages), F.col("rate")).otherwise(F.raise_error(F.lit("a model lacks counts at some stage")).cast("double")))
    a, b = rows.select(*[F.col(c).alias(f"a_{c}") for c in ("m", "stage", "stage_no", "rate", "low", "high")]), rows.select(*[F.col(c).alias(f"b_{c}") for c in ("m", "stage_no", "rate", "low", "high")])
    pairs = a.join(b, (F.col("a_stage_no") == F.col("b_stage_no")) & (F.col("a_m") < F.col("b_m")))
    apart = (F.col("a_low") > F.col("b_high")) | (F.col("b_low") > F.col("a_high"))
    return pairs.select(F.col("a_stage_no").alias("stage_no"), F.col("a_stage").alias("stage"), F.col("a_m").alias("left_model"), F.col("b_m").alias("right_model"), F.col("a_rate").alias("left_rate"), F.col("b_rate").alias("right_rate"), apart.alias("decidable"))


def deepest_decidable(audit: DataFrame) -> DataFrame:
    """stage: the last stage at which any two models can be told apart; null if there is none."""
    return audit.agg(F.max_by(F.when(F.col("decidable"), F.col("stage")), F.when(F.col("decidable"), F.col("stage_no"))).alias("stage"))


def seat_skills(votes: DataFrame, record: str, seat: str, vote: str, truth: str) -> DataFrame:
    """seat, answered, abstained, youden, youden_low of each seat from refuse / clear / abstain against a boolean truth."""
    call, real = F.col(vote) == "refuse", F.col(truth)
    given = F.col(vote) != "abstain"
    n = votes.groupBy(seat).agg(
        F.count_if(given).alias("answered"), F.count_if(~given).alias("abstained"), F.count_if(call & real).alias("tp"), F.count_if(call & ~real).alias("fp"),
        F.count_if(given & ~call & ~real).alias("tn"), F.count_if(given & ~call & real).alias("fn"),
    )
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    (sl, _), (cl, _) = wilson(F.col("tp"), pos), wilson(F.col("tn"), neg)
    share = lambda a, b: F.when(b > 0, a / b)
    return n.select(seat, "answered", "abstained", (share(F.col("tp"), pos) + share(F.col("tn"), neg) - 1).alias("youden"), (sl + cl - 1).alias("youden_low"))


def pairwise_kappa(votes: DataFrame, record: str, seat: str, vote: str) -> DataFrame:
    """left_seat, right_seat, kappa of all pairs of seats over the records that both voted on: one join by record."""
    a = votes.select(F.col(record).alias("r"), F.col(seat).alias("left_seat"), F.col(vote).alias("x"))
    b = votes.select(F.col(record).alias("q"), F.col(seat).alias("right_seat"), F.col(vote).alias("y"))
    cells = a.join(b, (F.col("r") == F.col("q")) & (F.col("left_seat") < F.col("right_seat"))).groupBy("left_seat", "right_seat", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    pair = Window.partitionBy("left_seat", "right_seat")  # a few cells each
    marks = cells.withColumn("n", F.sum("c").over(pair)).withColumn("mx", F.sum("c").over(Window.partitionBy("left_seat", "right_seat", "x"))).withColumn("my", F.sum("c").over(Window.partitionBy("left_seat", "right_seat", "y")))
    same = marks.groupBy("left_seat", "right_seat").agg((F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)) / F.max("n")).alias("po"))
    left = marks.select("left_seat", "right_seat", "x", "mx", "n").distinct()
    right = marks.select(F.col("left_seat").alias("l2"), F.col("right_seat").alias("r2"), F.col("y"), "my").distinct()
    chance = left.join(right, (F.col("left_seat") == F.col("l2")) & (F.col("right_seat") == F.col("r2")) & (F.col("x") == F.col("y")), "left").groupBy("left_seat", "right_seat").agg(F.sum(F.coalesce(F.col("mx") * F.col("my"), F.lit(0)) / (F.col("n") * F.col("n"))).alias("pe"))
    kappa = F.when(1 - F.col("pe") < 1e-12, 0.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return same.join(chance, ["left_seat", "right_seat"]).select("left_seat", "right_seat", kappa.alias("kappa"))


def council_ruling(votes: DataFrame, record: str, seat: str, vote: str, truth: str, least_labels: int) -> DataFrame:
    """labels, seats, worst_low, mean_kappa, effective_votes, qualified, refusal.

    Refused with too few labelled records, where a seat saw one class only, or where a seat's lower bound on Youden's J is
    not above zero. Votes that agree are worth fewer: seats / (1 + (seats - 1) * mean kappa), all of them if that mean is
    not positive.
    """
    skills = seat_skills(votes, record, seat, vote, truth).agg(F.count(F.lit(1)).alias("seats"), F.min("youden_low").alias("worst_low"), F.count_if(F.col("youden_low").isNull()).alias("blind"))
    labels = votes.select(record).distinct().agg(F.count(F.lit(1)).alias("labels"))
    kappa = pairwise_kappa(votes, record, seat, vote).agg(F.avg("kappa").alias("mean_kappa"))
    rho = F.col("mean_kappa")
    worth = F.when((F.col("seats") <= 1) | rho.isNull() | (rho <= 0), F.col("seats").cast("double")).otherwise(F.col("seats") / (1 + (F.col("seats") - 1) * rho))
    refusal = F.when(F.col("labels") < least_labels, "TOO_FEW_LABELS").when(F.col("blind") > 0, "ONE_CLASS_SEAT").when(F.col("worst_low") <= 0, "SEAT_AT_CHANCE")
    out = labels.crossJoin(skills).crossJoin(kappa).withColumn("refusal", refusal)  # one row each
    return out.select("labels", "seats", "worst_low", "mean_kappa", worth.alias("effective_votes"), F.col("refusal").isNull().alias("qualified"), "refusal")


def scope_overlaps(seats: DataFrame, seat: str, scope: str) -> DataFrame:
    """left_seat, right_seat, shared, relation (IDENTICAL or PARTIAL) of seats whose evidence scopes (arrays) meet."""
    items = seats.select(F.col(seat).alias("s"), F.explode(F.array_distinct(scope)).alias("i"), F.size(F.array_distinct(scope)).alias("n"))
    a, b = items.select(F.col("s").alias("left_seat"), "i", F.col("n").alias("ln")), items.select(F.col("s").alias("right_seat"), F.col("i").alias("j"), F.col("n").alias("rn"))
    shared = a.join(b, (F.col("i") == F.col("j")) & (F.col("left_seat") < F.col("right_seat"))).groupBy("left_seat", "right_seat").agg(F.count(F.lit(1)).alias("shared"), F.max("ln").alias("ln"), F.max("rn").alias("rn"))
    same = (F.col("shared") == F.col("ln")) & (F.col("shared") == F.col("rn"))
    return shared.select("left_seat", "right_seat", "shared", F.when(same, "IDENTICAL").otherwise("PARTIAL").alias("relation"))


def partition_observations(observations: DataFrame, taxonomy: DataFrame, waived: Sequence[str]) -> DataFrame:
    """Observations with part: BLOCKING, WAIVED, BOUNDED, UNVERIFIABLE, UNCHECKED or CLEAR; an unknown code is an error.

    ``observations`` has code, fired, evaluable; ``taxonomy`` (code, consequence) is a small closed table.
    """
    known = observations.join(F.broadcast(taxonomy.select(F.col("code").alias("__c"), "consequence")), F.col("code") == F.col("__c"), "left").drop("__c")
    released = F.col("code").isin(list(waived)) if waived else F.lit(False)
    part = (
        F.when(F.col("consequence").isNull(), F.raise_error(F.concat(F.lit("unknown fault "), F.col("code")))).when(~F.col("evaluable"), "UNCHECKED").when(~F.col("fired"), "CLEAR")
        .when(F.col("consequence") == "UNVERIFIABLE", "UNVERIFIABLE").when(F.col("consequence") == "WRONG_SIZE", "BOUNDED")
        .when(F.col("consequence") == "WRONG_SUBJECT", F.when(released, "WAIVED").otherwise("BLOCKING"))
    )
    return known.withColumn("part", part.cast("string"))


def admissibility(measurements: DataFrame, parts: DataFrame, key: str, expensive: str, cheap: str, require_comparator: bool = True) -> DataFrame:
    """key, blocking, waived, unchecked, admission, reproducible: which measurements may teach.

    Values that are not finite, or missing, block as faults do. ``parts`` are partitioned observations by key.
    """
    odd = lambda c, name: F.when(F.col(c).isNotNull() & ~finite(F.col(c)), F.lit(f"NONFINITE_{name}"))
    own = F.array_compact(F.array(odd(cheap, "CHEAP_VALUE"), odd(expensive, "EXPENSIVE_VALUE"), F.when(F.col(expensive).isNull(), F.lit("NO_EXPENSIVE_VALUE")), F.when(F.col(cheap).isNull() & F.lit(require_comparator), F.lit("NO_CHEAP_VALUE"))))
    n = lambda p: F.count_if(F.col("part") == p)
    found = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("part") == "BLOCKING", F.col("code")))).alias("__b"), n("WAIVED").alias("w"), n("UNCHECKED").alias("u"), n("UNVERIFIABLE").alias("v"))
    rows = measurements.withColumn("__own", own).join(found, key, "left")
    blocking = F.sort_array(F.concat("__own", F.coalesce("__b", F.array().cast("array<string>"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    admission = F.when(F.size(blocking) > 0, "WITHHELD").when(zero("w") > 0, "ADMITTED_UNDER_WAIVER").otherwise("ADMITTED")
    return rows.select(key, F.array_join(blocking, ",").alias("blocking"), zero("w").alias("waived"), zero("u").alias("unchecked"), admission.alias("admission"), (zero("v") == 0).alias("reproducible"))


def preflight(rows: DataFrame, key: str, receptor_digest: str | None, toolchain: bool | None) -> DataFrame:
    """key, code, fired, evaluable: every observable of a handoff row, those that did not fire as well.

    A check that cannot be made is not evaluable, which is not the same as clean. Columns: status, coordinate_source,
    hydrogens, receptor_id, protonation, stereo, parent.
    """
    bound = F.coalesce(F.col("coordinate_source").isin("DOCKED_POSE", "REFINED_POSE"), F.lit(False))
    has = F.coalesce(F.length("receptor_id") > 0, F.lit(False))
    known = F.coalesce((F.length("stereo") > 0) & (F.length("parent") > 0), F.lit(False))
    compare = ~bound | (has & F.lit(receptor_digest is not None))
    other = F.element_at(F.split("receptor_id", ":"), -1) != F.lit(receptor_digest)
    yes, no = F.lit(True), F.lit(False)
    checks: list[tuple[str, Column, Column]] = [
        ("F_STRUCTURE_UNREADABLE", ~F.col("status").eqNullSafe("OK"), yes),
        ("F_COORDINATES_ARE_A_DEPICTION", F.col("coordinate_source").eqNullSafe("TWO_D_DEPICTION"), yes),
        ("F_HYDROGENS_IMPLICIT", ~F.coalesce(F.col("hydrogens").isin("EXPLICIT", "ADDED"), no), yes),
        ("F_POSE_WITHOUT_RECEPTOR", bound & ~has, yes),
        ("F_RECEPTOR_NOT_THE_ONE_SCORED", bound & compare & F.coalesce(other, no), compare),
        ("F_PROTONATION_UNDECIDED", F.col("protonation").eqNullSafe("UNDECIDED"), yes),
        ("F_STEREO_CHOSEN_BY_EMBEDDING", known & F.coalesce(F.col("stereo") != F.col("parent"), no), known),
        ("F_RUN_NOT_REPRODUCIBLE", F.lit(toolchain is False), F.lit(toolchain is not None)),
        ("F_FEP_MAPPING_DEGENERATE", no, no),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), f.alias("fired"), e.alias("evaluable")) for c, f, e in checks])).alias("x")
    return rows.select(key, each).select(key, "x.code", "x.fired", "x.evaluable")


def missing_records(expected: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """code, expected, missing, fired: expected molecules that no record speaks about."""
    left = expected.select(key).distinct()
    found = left.join(records.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    return found.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("__in").isNull()).alias("missing")).select(F.lit("F_HANDOFF_ABSENT").alias("code"), "expected", "missing", (F.col("missing") > 0).alias("fired"))


def postflight(manifests: DataFrame, key: str, body: str, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """key, code, fired, evaluable from JSON manifests: a check names a path and a test of its value (column ``value``).

    An absent member cannot be checked.
    """
    out = None
    for code, (path, bad) in checks.items():
        one = manifests.select(F.col(key), F.lit(code).alias("code"), F.get_json_object(body, path).alias("value"))
        one = one.select(key, "code", F.coalesce(bad, F.lit(False)).alias("fired"), F.col("value").isNotNull().alias("evaluable"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no checks")
    return out


def alert_gate(entities: DataFrame, matches: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, n_alerts, n_demerits, reason_code, passed: structural alerts against a rule table.

    ``matches`` has key, rule, n; ``rules`` (rule, max_count, action, demerit) is small. More matches than a rule allows
    raise its alert; action REJECT rejects, WARN lets pass with a warning; demerits of raised alerts add up.
    """
    raised = matches.join(F.broadcast(rules), "rule").filter(F.col("n") > F.col("max_count"))
    per = raised.groupBy(key).agg(F.count(F.lit(1)).alias("a"), F.sum("demerit").alias("d"), F.count_if(F.col("action") == "REJECT").alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = entities.join(per, key, "left").select(key, zero("a").alias("n_alerts"), zero("d").alias("n_demerits"), zero("r").alias("r"))
    reason = F.when(F.col("r") > 0, "ALERT_REJECT").when(F.col("n_alerts") > 0, "ALERT_WARN").otherwise("ALERT_PASS")
    return out.select(key, "n_alerts", "n_demerits", reason.alias("reason_code"), (F.col("r") == 0).alias("passed"))


def severity_gate(entities: DataFrame, findings: DataFrame, key: str, severity: str, limit: int) -> DataFrame:
    """key, worst, passed: the largest severity of any finding (0 without one) must not pass the limit."""
    worst = findings.groupBy(key).agg(F.max(severity).alias("w"))
    return entities.join(worst, key, "left").select(key, F.coalesce("w", F.lit(0)).alias("worst"), (F.coalesce("w", F.lit(0)) <= limit).alias("passed"))


def refusals(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key, reasons (those that hold, in the rules' order, comma-joined), passed: per-field refusals of a handoff row."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.array_join(held, ",").alias("reasons"), (F.size(held) == 0).alias("passed"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def one_direction(rows: DataFrame, direction: str) -> DataFrame:
    """The rows, or an error when their values disagree on the direction that is stronger: one aggregate, then a test a row."""
    seen = rows.agg(F.min(direction).alias("__lo"), F.max(direction).alias("__hi"))
    ok = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.lit(True)).otherwise(F.raise_error(F.lit("directions disagree")).cast("boolean"))
    return rows.crossJoin(F.broadcast(seen)).filter(ok).drop("__lo", "__hi")  # one row


def branch_rule(df: DataFrame, value: str, good: Column) -> DataFrame:
    """threshold, correct, n: the split value <= threshold that calls most rows right (the least such threshold).

    Counted by value, then read off cumulative counts.
    """
    by = df.filter(finite(F.col(value))).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(good).alias("g"), F.count_if(~good).alias("b"))
    total = by.agg(F.sum("b").alias("tb"), (F.sum("g") + F.sum("b")).alias("n"))
    cuts = cumulative(by, "v", ["g", "b"]).crossJoin(F.broadcast(total))  # one row
    right = F.col("before_g") + F.col("g") + F.col("tb") - F.col("before_b") - F.col("b")
    best = cuts.agg(F.max(F.struct(right.alias("c"), (-F.col("v")).alias("t"), F.col("n").alias("n"))).alias("m"))
    return best.select((-F.col("m.t")).alias("threshold"), F.col("m.c").alias("correct"), F.col("m.n").alias("n"))


def paired_moments(df: DataFrame, x: str, y: str) -> DataFrame:
    """Means and population deviations of two endpoints, and their correlation shrunk by n / (n + 3) over complete pairs."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    out = df.agg(
        F.avg(a).alias("mean_x"), F.stddev_pop(a).alias("std_x"), F.avg(b).alias("mean_y"), F.stddev_pop(b).alias("std_y"), F.count_if(both).alias("pairs"), F.corr(a, b).alias("r")
    )
    return out.select("mean_x", "std_x", "mean_y", "std_y", "pairs", F.when(F.col("pairs") >= 3, F.col("r") * F.col("pairs") / (F.col("pairs") + 3)).alias("shrunk"))


