"""Records of research: quotas, watermarks, fenced work, evidence windows, versions, relations, lineage, panels, ingress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small


def within_quota(actions: DataFrame, quotas: DataFrame, group: str, order: Sequence[str], cost: str) -> DataFrame:
    """Actions with taken, charged (both up to and with the row, in order) and admitted: within the group's caps.

    ``quotas`` has group, max_count and max_cost; a group without a row, or with a null cap, has none.
    """
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = actions.withColumn("taken", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).withColumn("charged", F.sum(cost).over(run))
    caps = quotas.select(F.col(group).alias("__g"), "max_count", "max_cost")
    out = rows.join(small(caps), F.col(group) == F.col("__g"), "left")
    ok = F.coalesce(F.col("taken") <= F.col("max_count"), F.lit(True)) & F.coalesce(F.col("charged") <= F.col("max_cost"), F.lit(True))
    return out.withColumn("admitted", ok).drop("__g", "max_count", "max_cost")


def watermarks(events: DataFrame, source: str, sequence: str) -> DataFrame:
    """source, watermark (the largest sequence), n, complete: whether every number from the least to it is there once."""
    out = events.groupBy(source).agg(F.max(sequence).alias("watermark"), F.min(sequence).alias("__lo"), F.count(F.lit(1)).alias("n"), F.countDistinct(sequence).alias("__d"))
    return out.select(source, "watermark", "n", ((F.col("__d") == F.col("n")) & (F.col("watermark") - F.col("__lo") + 1 == F.col("n"))).alias("complete"))


def sequence_faults(events: DataFrame, journal: str, sequence: str) -> DataFrame:
    """journal, sequence, before: rows whose number does not follow the one before by one."""
    w = Window.partitionBy(journal).orderBy(sequence)
    rows = events.select(journal, sequence, F.lag(sequence).over(w).alias("before"))
    return rows.filter(F.col("before").isNotNull() & (F.col(sequence) != F.col("before") + 1))


def fenced(writes: DataFrame, job: str, epoch: str, at: str, order: Sequence[str]) -> DataFrame:
    """Writes with published: whether the job had not begun a later epoch when the write came; ``at`` orders writes."""
    run = Window.partitionBy(job).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    return writes.withColumn("published", F.col(epoch) >= F.max(epoch).over(run))


def heartbeat_gaps(beats: DataFrame, worker: str, at: str, order: Sequence[str], limit_seconds: float) -> DataFrame:
    """worker, n, longest (seconds between beats that follow each other) and stale."""
    w = Window.partitionBy(worker).orderBy(at, *order)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = beats.select(worker, (seconds - F.lag(seconds).over(w)).alias("gap"))
    out = rows.groupBy(worker).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("longest"))
    return out.withColumn("stale", F.coalesce(F.col("longest") > limit_seconds, F.lit(False)))


def evidence_window(evidence: DataFrame, decisions: DataFrame, task: str, sequence: str, key: str) -> DataFrame:
    """task, decision, visible, hidden, latest: per decision how much of its task's evidence was there at its cutoff.

    ``decisions`` has task, decision and cutoff. The counts come from one sort of both by sequence, not from all pairs.
    """
    a = evidence.select(F.col(task).alias("t"), F.col(sequence).alias("s"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("decision"), F.col(key).alias("k"))
    b = decisions.select(F.col(task).alias("t"), F.col("cutoff").alias("s"), F.lit(1).alias("side"), F.col("decision").cast("bigint").alias("decision"), F.lit(None).cast(evidence.schema[key].dataType).alias("k"))
    run = Window.partitionBy("t").orderBy("s", "side", "decision").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("visible", F.sum(1 - F.col("side")).over(run)).withColumn("latest", F.last("k", ignorenulls=True).over(run)).withColumn("total", F.sum(1 - F.col("side")).over(Window.partitionBy("t")))
    return rows.filter("side = 1").select(F.col("t").alias(task), "decision", F.col("visible").cast("bigint"), (F.col("total") - F.col("visible")).cast("bigint").alias("hidden"), "latest")


def heads(versions: DataFrame, key: str, sequence: str, expected: str, record: str) -> DataFrame:
    """key, head, applied, refused: compare-and-set of a head pointer, version after version.

    A version applies if it expects the head that holds (null: none), and its own record is the head then. A key's versions
    are folded in one row.
    """
    steps = F.sort_array(F.collect_list(F.struct(F.col(sequence).alias("s"), F.col(expected).alias("e"), F.col(record).alias("r"))))
    start = F.struct(F.lit(None).cast(versions.schema[record].dataType).alias("h"), F.lit(0).alias("n"))
    fold = F.aggregate(steps, start, lambda a, x: F.when(x["e"].eqNullSafe(a["h"]), F.struct(x["r"].alias("h"), (a["n"] + 1).alias("n"))).otherwise(a))
    out = versions.groupBy(key).agg(fold.alias("f"), F.count(F.lit(1)).alias("c"))
    return out.select(key, F.col("f.h").alias("head"), F.col("f.n").cast("bigint").alias("applied"), (F.col("c") - F.col("f.n")).alias("refused"))


def relations(documents: DataFrame, key: str, refs: Mapping[str, Column]) -> DataFrame:
    """source, relation, target: the explicit references of records, one row each; ``refs`` gives arrays by relation."""
    parts = [documents.select(F.col(key).alias("source"), F.lit(name).alias("relation"), F.explode(F.array_distinct(F.array_compact(c))).alias("target")) for name, c in refs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """References whose target is no record."""
    known = nodes.select(F.col(key).alias("target")).distinct()
    return edges.join(known, "target", "left_anti")


def lineage(artifacts: DataFrame, steps: DataFrame, artifact: str, step: str) -> DataFrame:
    """producer, artifact, consumer: which step's artifact which other one read. ``artifacts`` has artifact and producer,
    ``steps`` artifact and step. Artifacts that nothing reads, and inputs that nothing made, keep a null."""
    made, read = artifacts.select(artifact, F.col(step).alias("producer")), steps.select(artifact, F.col(step).alias("consumer"))
    return made.join(read, artifact, "full").select("producer", artifact, "consumer")


def explain(decisions: DataFrame, stages: Sequence[str], entity: str) -> DataFrame:
    """stage_no, stage_id, outcome, reason_code, removed of one entity in the order of the stages."""
    number = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    rows = decisions.filter(F.col("entity_id") == F.lit(entity))
    return rows.select(number[F.col("stage_id")].alias("stage_no"), "stage_id", "outcome", "reason_code", (F.col("outcome") == "REJECT").alias("removed")).orderBy("stage_no", "outcome")


def byte_pages(rows: DataFrame, lane: str, order: Sequence[str], body: Column, max_bytes: int) -> DataFrame:
    """Rows with page: a lane's rows in order, cut where the bytes before a row fill whole pages.

    Pages lose nothing; one holds at most max_bytes and a row. Lanes (a hash or a task) keep windows small.
    """
    before = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("page", F.floor(F.coalesce(F.sum(F.octet_length(body)).over(before), F.lit(0)) / max_bytes).cast("bigint"))


def within_bytes(rows: DataFrame, lane: str, order: Sequence[str], body: Column, max_bytes: int) -> DataFrame:
    """Rows with included: those whose bytes, with all before them in order, stay within the budget."""
    run = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("included", F.sum(F.octet_length(body)).over(run) <= max_bytes)


def trace_projection(records: DataFrame, subject: str, phase: str, value: str, phases: Sequence[str]) -> DataFrame:
    """subject and, per phase, the number of its distinct records: repeats of a record count once."""
    rows = records.select(subject, phase, value).distinct()
    return rows.groupBy(subject).agg(*[F.count_if(F.col(phase) == p).alias(p) for p in phases])


def accounting(receipts: DataFrame, node: str, costs: Column) -> DataFrame:
    """node, kind, total, n from maps of costs; unknown (null) costs count as a receipt without an amount."""
    rows = receipts.select(node, F.explode_outer(costs).alias("kind", "amount"))
    return rows.filter("kind is not null").groupBy(node, "kind").agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))


def grid(results: DataFrame, left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Every combination of two dimensions with n and mean of its results; combinations without any keep a null mean.

    The dimensions are closed lists of levels, so the grid is what is asked for, not a join of data.
    """
    cells = results.groupBy(*on).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    whole = small(left).crossJoin(small(right))
    return whole.join(cells, list(on), "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def contrasts(cells: DataFrame, arm: str, block: str, value: str, base: str) -> DataFrame:
    """arm, pairs, mean_difference: differences to the base arm within blocks that have both."""
    ref = cells.filter(F.col(arm) == base).groupBy(block).agg(F.max(block).alias("__b"), F.avg(value).alias("__v")).drop(block)
    own = cells.filter(F.col(arm) != base).groupBy(arm, block).agg(F.avg(value).alias("v"))
    return own.join(ref, F.col(block) == F.col("__b")).groupBy(arm).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("v") - F.col("__v")).alias("mean_difference"))


def joint_outcomes(rows: DataFrame, outcomes: Sequence[str], group: str | None = None) -> DataFrame:
    """The outcomes' joint distribution over complete rows: probability and n; balanced, each group weighs the same."""
    known = rows.dropna(subset=list(outcomes))
    if group is None:
        cells = known.groupBy(*outcomes).agg(F.count(F.lit(1)).alias("n"))
        total = cells.agg(F.sum("n").alias("__t"))
        return cells.crossJoin(F.broadcast(total)).select(*outcomes, "n", (F.col("n") / F.col("__t")).alias("probability"))  # one row
    sizes = known.groupBy(group).agg(F.max(group).alias("__g"), F.count(F.lit(1)).alias("__n")).drop(group)
    total = sizes.agg(F.count(F.lit(1)).alias("__t"))
    cells = known.groupBy(group, *outcomes).agg(F.count(F.lit(1)).alias("c")).join(sizes, F.col(group) == F.col("__g")).crossJoin(F.broadcast(total))  # one row
    return cells.groupBy(*outcomes).agg(F.sum("c").alias("n"), F.sum(F.col("c") / F.col("__n") / F.col("__t")).alias("probability"))


def discretise(value: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """The first label whose upper end the value does not reach; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, label in cuts:
        out = out.when(value < upper, label)
    return out.otherwise(last)


def split_leaks(rows: DataFrame, identity: str, split: str) -> DataFrame:
    """identity, splits: identities that more than one split holds."""
    return rows.groupBy(identity).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("__n")).filter("__n > 1").drop("__n")


def missing_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, missing of every required column."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")
    return counts.select(each).select("x.column", "x.missing")


def support(rows: DataFrame, group: str, value: str, low: float, high: float) -> DataFrame:
    """group, known, unknown, least, greatest: bounds of a mean when unknown values may lie anywhere between the limits."""
    n, k = F.count(F.lit(1)), F.count(value)
    total = F.coalesce(F.sum(value), F.lit(0.0))
    return rows.groupBy(group).agg(k.alias("known"), (n - k).alias("unknown"), ((total + (n - k) * low) / n).alias("least"), ((total + (n - k) * high) / n).alias("greatest"))


def completeness(results: DataFrame, key: str, checks: Column, expected: Sequence[str]) -> DataFrame:
    """key, missing, unexpected (comma-joined), complete of each result's check names against a frozen list."""
    want = F.array(*[F.lit(c) for c in expected])
    lost, odd = F.sort_array(F.array_except(want, checks)), F.sort_array(F.array_except(checks, want))
    return results.select(key, F.array_join(lost, ",").alias("missing"), F.array_join(odd, ",").alias("unexpected"), ((F.size(lost) == 0) & (F.size(odd) == 0)).alias("complete"))


def recommendation(rows: DataFrame, group: str, key: str, predicted: str, attainable: Column, measured: str) -> DataFrame:
    """group, unrestricted, attainable and evidence: ids of the best prediction, of the best that can be had, and of the
    best measured value. Ties go to the least id."""
    best = lambda test, v: F.max(F.when(test & F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), (-F.col(key)).alias("k"))))
    out = rows.groupBy(group).agg(best(F.lit(True), predicted).alias("a"), best(attainable, predicted).alias("b"), best(F.lit(True), measured).alias("c"))
    return out.select(group, (-F.col("a.k")).alias("unrestricted"), (-F.col("b.k")).alias("attainable"), (-F.col("c.k")).alias("evidence"))


def edit_sets(designs: DataFrame, key: str, edits: Sequence[tuple[str, str]], max_edits: int) -> DataFrame:
    """key, edits, n: each design with every set of at most max_edits allowed (field, value) edits, one a field.

    The list of edits is short and closed; sets are numbered by bits, and those that touch a field twice go.
    """
    if len(edits) > 16:
        raise ValueError("more than 16 edits: the sets would be too many")
    names = F.array(*[F.lit(f"{f}={v}") for f, v in edits])
    fields = F.array(*[F.lit(f) for f, _ in edits])
    sets = designs.select(key, F.explode(F.sequence(F.lit(0), F.lit((1 << len(edits)) - 1))).alias("__m")).filter(F.bit_count("__m") <= max_edits)
    held = lambda a: F.filter(a, lambda x, i: F.expr("__m").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    out = sets.withColumn("__e", held(names)).withColumn("__f", held(fields)).filter(F.size(F.array_distinct("__f")) == F.size("__f"))
    return out.select(key, F.array_join("__e", ",").alias("edits"), F.size("__e").alias("n"))


def review_template(measurements: DataFrame, key: str, endpoint: str, unit: str) -> DataFrame:
    """Rows for a reviewer: each measurement of the library with the endpoint it is asked for, not reviewed yet."""
    return measurements.select(key, F.lit(endpoint).alias("endpoint"), F.lit(unit).alias("unit"), F.lit(False).alias("reviewed"))


def import_assays(reviews: DataFrame, key: str, experiment: Column, value: str, factors: Mapping[str, float], unit: str, relation: str, reviewed: Column) -> DataFrame:
    """experiment_id, key, molar: reviewed, uncensored rows of a known unit, one an experiment (the least key).

    experiment_id hashes what makes an experiment one. Units convert by exact factors, a short closed list.
    """
    scale = F.create_map(*[x for u, f in factors.items() for x in (F.lit(u), F.lit(f))])
    ok = reviewed & (F.col(relation) == "=") & scale[F.col(unit)].isNotNull() & (F.col(value) > 0)
    rows = reviews.filter(ok).select(F.sha2(experiment.cast("string"), 256).alias("experiment_id"), F.struct(F.col(key).alias("k"), (F.col(value) * scale[F.col(unit)]).alias("v")).alias("r"))
    first = rows.groupBy("experiment_id").agg(F.min("r").alias("r"))
    return first.select("experiment_id", F.col("r.k").alias(key), F.col("r.v").alias("molar"))


def import_candidates(pool: DataFrame, library: DataFrame, key: str, origin: str) -> DataFrame:
    """key, origins, added: the pool after an idempotent import; a candidate keeps every origin it ever had."""
    rows = pool.select(key, origin, F.lit(True).alias("__old")).unionByName(library.select(key, origin, F.lit(False).alias("__old")))
    out = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(origin)), ",").alias("origins"), F.max("__old").alias("__o"))
    return out.select(key, "origins", (~F.col("__o")).alias("added"))


def prepare_library(rows: DataFrame, key: str, body: str, identity_path: str, structure_path: str) -> DataFrame:
    """key, name, structure, status from nested JSON by dotted paths: REGISTERED, or why a row has no identity."""
    name, structure = F.get_json_object(body, f"$.{identity_path}"), F.get_json_object(body, f"$.{structure_path}")
    status = F.when(name.isNull(), "NO_IDENTITY").when(structure.isNull(), "NO_STRUCTURE").otherwise("REGISTERED")
    return rows.select(key, name.alias("name"), structure.alias("structure"), status.alias("status"))


def attach(candidates: DataFrame, handoffs: DataFrame, key: str, immutable: Sequence[str]) -> DataFrame:
    """Candidates that have a handoff, with attached and conflict: immutable columns must agree (null on neither side)."""
    other = handoffs.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in immutable])
    same = F.lit(True)
    for c in immutable:
        same = same & F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    return candidates.join(other, F.col(key) == F.col("__k")).select(key, same.alias("attached"), (~same).alias("conflict"))


def unnest_bundle(bundles: DataFrame, key: str, items: str) -> DataFrame:
    """key, position, item: one row an element of a nested array; bundles without elements keep one row with nulls."""
    return bundles.select(key, F.posexplode_outer(items).alias("position", "item"))


def sourcing(queries: DataFrame, offers: DataFrame, key: str, exact: str, parent: str) -> DataFrame:
    """key, match, offers: EXACT where an offer has the same structure, PARENT where only the parent is the same, else NONE."""
    by_exact = offers.groupBy(exact).agg(F.max(exact).alias("__x"), F.count(F.lit(1)).alias("__nx")).drop(exact)
    by_parent = offers.groupBy(parent).agg(F.max(parent).alias("__p"), F.count(F.lit(1)).alias("__np")).drop(parent)
    rows = queries.join(by_exact, F.col(exact) == F.col("__x"), "left").join(by_parent, F.col(parent) == F.col("__p"), "left")
    match = F.when(F.col("__nx") > 0, "EXACT").when(F.col("__np") > 0, "PARENT").otherwise("NONE")
    return rows.select(key, match.alias("match"), F.coalesce("__nx", "__np", F.lit(0)).alias("offers"))


def authorised(rows: DataFrame, tokens: DataFrame, digest: Column, on: str) -> DataFrame:
    """Rows with authorised: a token names the row's digest and has not expired on the day ``on`` (yyyy-mm-dd)."""
    live = tokens.filter(F.col("expires") >= F.to_date(F.lit(on))).select(F.col("digest").alias("__d")).distinct().withColumn("__ok", F.lit(True))
    return rows.withColumn("__r", digest).join(live, F.col("__r") == F.col("__d"), "left").withColumn("authorised", F.coalesce("__ok", F.lit(False))).drop("__r", "__d", "__ok")


def gate_authorisation(calibrations: DataFrame, key: str, recall: float, separation: str, issued: str, hours: int, now: str) -> DataFrame:
    """key, granted, reason: recall and a separating score are required, and the grant must not have run out."""
    expired = F.col(issued).cast("timestamp") + F.expr(f"INTERVAL {int(hours)} HOURS") < F.to_timestamp(F.lit(now))
    reason = F.when(F.col("recall").isNull() | (F.col("recall") < recall), "RECALL").when(~F.coalesce(F.col(separation), F.lit(False)), "NO_SEPARATION").when(expired, "EXPIRED")
    return calibrations.select(key, reason.isNull().alias("granted"), reason.alias("reason"))


def replay(changes: DataFrame, journal: str, sequence: str, field: str, value: str, live: Column) -> DataFrame:
    """journal, field, value in force: of the changes that hold, the last one of each field."""
    kept = changes.filter(live)
    return kept.groupBy(journal, field).agg(F.max_by(value, sequence).alias(value))


def missing_shards(plan: DataFrame, markers: DataFrame, stage: str, shard: str, digest: str) -> DataFrame:
    """Planned shards to run again: those without a completed marker of the same digest."""
    return plan.join(markers.select(stage, shard, digest).distinct(), [stage, shard, digest], "left_anti")


def with_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the set; a set of a looked-at size is broadcast, a larger one shuffled."""
    return rows.join(small(keys.select(key).distinct()), key, "left_semi")


def catalogue_matches(structures: DataFrame, catalogue: DataFrame, key: str, structure: Column, offered: Column) -> DataFrame:
    """key, offers: equal keys of structures and offers, whatever the case and outer blanks; structures without any count 0."""
    norm = lambda c: F.lower(F.trim(c))
    n = catalogue.groupBy(norm(offered).alias("__o")).agg(F.count(F.lit(1)).alias("__n"))
    return structures.join(n, norm(structure) == F.col("__o"), "left").select(key, F.coalesce("__n", F.lit(0)).alias("offers"))


def integrate_review(assertions: DataFrame, records: DataFrame, key: str, ref: str, value: str) -> DataFrame:
    """key, asserted, unresolved, conflicting: assertions by subject; one must resolve to a fetched record, and differing
    ones are all kept."""
    known = records.select(F.col(ref).alias("__r")).distinct().withColumn("__ok", F.lit(True))
    rows = assertions.join(known, F.col(ref) == F.col("__r"), "left")
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("asserted"), F.count_if(F.col("__ok").isNull()).alias("unresolved"), F.countDistinct(F.when(F.col("__ok"), F.col(value))).alias("__d"))
    return out.select(key, "asserted", "unresolved", (F.col("__d") > 1).alias("conflicting"))


def delivery(survivors: DataFrame, origins: DataFrame, metadata: DataFrame, key: str, origin: str) -> DataFrame:
    """Survivors with every origin and its metadata: what a screen hands over with where it came from."""
    return survivors.join(origins, key).join(metadata, origin)


def order_hash(rows: DataFrame, key: str) -> DataFrame:
    """digest, n: sha256 over the ids in order, each after its length in bytes and a colon; for sets that fit one row."""
    ids = F.transform(F.sort_array(F.collect_list(F.col(key).cast("string"))), lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))
    return rows.agg(F.sha2(F.array_join(ids, "").cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def reference_set(references: DataFrame, structure: str, name: str) -> DataFrame:
    """structure, name (the least), n: distinct references; their set's id is order_hash of the structures."""
    return references.groupBy(structure).agg(F.min(name).alias(name), F.count(F.lit(1)).alias("n"))


def affordable_count(cost: Column, remaining: Column, limit: Column) -> Column:
    """How many at most fit what remains, with a relative tolerance of 1e-12; without a cost, the limit."""
    return F.when(cost <= 0, limit).otherwise(F.least(limit, F.floor(remaining / cost * (1 + 1e-12)))).cast("bigint")


def bounded_prefix(rows: DataFrame, lane: str, order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """Rows, in the author's order, whose costs add up to the budget at most; the first that doesn't fit ends a lane."""
    run = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__c", F.sum(cost).over(run)).filter(F.col("__c") <= budget * (1 + 1e-12)).drop("__c")


def policy_scores(mean: Column, spread: Column, cost: Column, seen: Column, admitted: Column, best: float, kappa: float) -> dict[str, Column]:
    """Scores of offers by policy: greedy, ucb, cost_only, cost_aware (expected improvement times the chance of a valid
    result, by cost)."""
    from .selection import expected_improvement

    valid = (1 + admitted) / (2 + seen)
    return {"greedy": mean, "ucb": mean + kappa * spread, "cost_only": -cost, "cost_aware": valid * expected_improvement(mean, spread, best) / cost}


def policy_choice(offers: DataFrame, key: str, lane: str, score: Column, cost: str, budget: float, scaffold: str | None = None) -> DataFrame:
    """Offers by rank of score (ties by key) within a lane's budget; with ``scaffold``, the best of each scaffold only."""
    rows = offers.withColumn("__s", score)
    if scaffold:
        best = rows.groupBy(lane, scaffold).agg(F.max(F.struct("__s", (-F.col(key)).alias("k"))).alias("m")).select(F.col(lane).alias("__l"), F.col(scaffold).alias("__f"), (-F.col("m.k")).alias("__k"))
        rows = rows.join(best, (F.col(lane) == F.col("__l")) & (F.col(scaffold) == F.col("__f")) & (F.col(key) == F.col("__k"))).drop("__l", "__f", "__k")
    w = Window.partitionBy(lane).orderBy(F.desc("__s"), key)
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("__c", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter(F.col("__c") <= budget).drop("__c", "__s")


def break_even(baseline: Column, candidate: Column, development: Column, uses: Column) -> tuple[Column, Column]:
    """Uses after which a cheaper candidate of equal quality has paid for its development (null: never), and whether the
    planned uses reach that."""
    saved = baseline - candidate
    n = F.when(saved > 0, F.ceil(development / saved)).cast("bigint")
    return n, F.coalesce(uses >= n, F.lit(False))


def append_sequence(journal: DataFrame, new: DataFrame, lane: str, sequence: str, order: Sequence[str]) -> DataFrame:
    """The new rows with the numbers that follow each lane's last one, from 1 where a lane is new."""
    from .ranks import ranked

    last = journal.groupBy(lane).agg(F.max(lane).alias("__l"), F.max(sequence).alias("__m")).drop(lane)
    rows = ranked(new, [lane], order, "__i").join(last, F.col(lane).eqNullSafe(F.col("__l")), "left")
    return rows.withColumn(sequence, F.coalesce("__m", F.lit(0)) + F.col("__i")).drop("__i", "__l", "__m")


def leases(claims: DataFrame, item: str, at: str, order: Sequence[str], who: str, seconds: float) -> DataFrame:
    """Claims with held: whether the item was free, that is, its last claim that held had run out. An item's claims are
    folded in one row, in order."""
    steps = F.array_sort(F.collect_list(F.struct((F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(who).cast("string").alias("w"))))
    start = F.struct(F.lit(None).cast("double").alias("until"), F.array().cast("array<struct<t:double,w:string,held:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        free = a["until"].isNull() | (x["t"] >= a["until"])
        return F.struct(F.when(free, x["t"] + seconds).otherwise(a["until"]).alias("until"), F.concat(a["out"], F.array(F.struct(x["t"].alias("t"), x["w"].alias("w"), free.alias("held")))).alias("out"))

    out = claims.groupBy(item).agg(F.aggregate(steps, start, step).alias("f")).select(item, F.explode("f.out").alias("x"))
    return out.select(item, F.col("x.w").alias(who), F.col("x.held").alias("held"))


def json_page(rows: DataFrame, key: str, body: str, path: str, offset: int, limit: int) -> DataFrame:
    """key, total, position, item: one page of an array member of JSON bodies, named by its path."""
    items = F.from_json(F.get_json_object(body, path), "array<string>")
    found = rows.select(key, F.size(items).alias("total"), F.posexplode(F.slice(items, offset + 1, limit)).alias("p", "item"))
    return found.select(key, "total", (F.col("p") + offset).alias("position"), "item")


def contradictions(config: DataFrame, known: DataFrame, key: str, stage: str, low: str, high: str) -> DataFrame:
    """key, problem: a dry run's findings in a plan: stages that don't exist, empty windows, windows without an end, and
    stages that are configured twice."""
    names = known.select(F.col(stage).alias("__n")).distinct()
    twice = config.groupBy(stage).agg(F.max(stage).alias("__s"), F.count(F.lit(1)).alias("__c")).drop(stage)
    rows = config.join(names, F.col(stage) == F.col("__n"), "left").join(twice, F.col(stage) == F.col("__s"), "left")
    held = F.array_compact(F.array(
        F.when(F.col("__n").isNull(), "UNKNOWN_STAGE"), F.when(F.col(low) > F.col(high), "EMPTY_WINDOW"), F.when(F.col(low).isNull() & F.col(high).isNull(), "NO_BOUND"), F.when(F.col("__c") > 1, "STAGE_TWICE"),
    ))
    return rows.select(key, F.explode(held).alias("problem"))


def run_trace(decided: DataFrame, stages: Sequence[str]) -> DataFrame:
    """stage_no, stage_id, entering, passed, rejected, warned, reasons (how many different ones) by stage of a run."""
    number = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = decided.groupBy("stage_id").agg(n("PASS").alias("passed"), n("REJECT").alias("rejected"), n("WARN").alias("warned"), F.countDistinct("reason_code").alias("reasons"))
    return out.select(number[F.col("stage_id")].alias("stage_no"), "stage_id", (F.col("passed") + F.col("rejected")).alias("entering"), "passed", "rejected", "warned", "reasons")
