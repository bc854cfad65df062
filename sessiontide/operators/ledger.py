"""Cumulative ledgers: reversible contributions, unions of ledgers and overlays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AMOUNT_WEIGHTS, EXCLUDED_ITEM, EXCLUDED_SESSION, FIELD_WEIGHTS, MOST_SAMPLES, PENDING, SAMPLES_WEIGHT
from . import precedence


def is_newer(new: dict, old: dict | None) -> bool:
    """Whether an update goes beyond an earlier one: by revision, else not a replay of it, else by sequence or receipt."""
    if not old:
        return True
    if new["revision"] is not None and old["revision"] is not None and new["revision"] != old["revision"]:
        return new["revision"] > old["revision"]
    if new["fingerprint"] is not None and (new["fingerprint"] == old["fingerprint"] or new["fingerprint"] in (old["seen"] or ())):
        return False
    if new["instance"] == old["instance"]:
        return (new["sequence"] or 0) > (old["sequence"] or 0)
    return (new["received_at"] or 0) >= (old["received_at"] or 0)


def fold(records: list[dict]) -> dict | None:
    """The contribution that one message's records leave, applied in order of arrival; None if it is excluded."""
    held: dict | None = None
    for r in records:
        if r["scope"] in (EXCLUDED_ITEM, EXCLUDED_SESSION):
            return None  # for good
        if held:
            exact, was = (x["quality"] in (None, "exact") for x in (r, held))
            if was and not exact:
                continue
            if r["update"]:
                if held["update"] and not is_newer(r["update"], held["update"]):
                    continue
            elif held["update"] and exact == was:
                continue
        held = r
    return held


def completeness(r: dict) -> int:
    """Weight of the fields that a record has."""
    samples = len(r.get("samples") or ())
    fields = sum(w for c, w in FIELD_WEIGHTS.items() if r.get(c) is not None) + sum(w for c, w in AMOUNT_WEIGHTS.items() if (r.get(c) or 0) > 0)
    return fields + (SAMPLES_WEIGHT + min(samples, MOST_SAMPLES) if samples else 0)


def with_evidence(kept: dict, other: dict, later: dict) -> dict:
    """The kept record with the agent that it lacks and the evidence of both, `later` being the one that came last."""
    first = other if later is kept else kept
    out = kept | {"agent": kept["agent"] if kept["agent"] is not None else other["agent"]}
    if "scope" in kept:
        old, new = first["scope"], later["scope"]
        strong = next((x for x in (EXCLUDED_SESSION, EXCLUDED_ITEM) if x in (old, new)), None)
        out["scope"] = strong or (old if new in (None, PENDING) and old is not None else new)
    if "scope_reasons" in kept:
        out["scope_reasons"] = list(dict.fromkeys([*(first["scope_reasons"] or ()), *(later["scope_reasons"] or ())]))
        out["scope_parent"] = later["scope_parent"] if later["scope_parent"] is not None else first["scope_parent"]
    return out


def fold_history(records: list[dict]) -> dict | None:
    """The history's record of a message after its upserts in order of arrival.

    A record with a live update must go beyond the held one's, and never lets a provisional one replace an exact one; one
    without it yields to a held update of the same quality. Otherwise quality, completeness, freshness and arrival decide.
    Whichever stays keeps the place of admission, and takes over the agent that it lacks and the evidence of the other.
    """
    held: dict | None = None
    for r in records:
        if held is None:
            held = r
            continue
        exact, was = (x["quality"] in (None, "exact") for x in (r, held))
        if r["update"]:
            wins = is_newer(r["update"], held["update"]) and (exact or not was)
        elif held["update"] and exact == was:
            wins = False
        else:
            fresh = lambda x: max((x[c] for c in ("start", "first_token", "completed") if x.get(c) is not None), default=0)
            wins = (exact, completeness(r), fresh(r)) >= (was, completeness(held), fresh(held))
        held = with_evidence(r, held, r) | {"pos": held["pos"]} if wins else with_evidence(held, r, r)
    return held


def by_message(records: DataFrame, fold_, only: str | None = None) -> DataFrame:
    """A fold of each message's few records in order of arrival. They come sorted from one shuffle, and a task holds one
    message at a time; comparing updates is not transitive, so no window can do it. With `only`, a flag of whole messages, rows
    without it pass as they are."""
    kept = [c for c in records.columns if c != only]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        schema = None
        for batch in batches:
            if only:
                flags = batch.column(batch.schema.get_field_index(only))
                batch = batch.select(kept)
                if rest := pc.sum(pc.invert(flags)).as_py():
                    yield batch.filter(pc.invert(flags))
                if rest == batch.num_rows:
                    continue
                batch = batch.filter(flags)
            schema, out = batch.schema, []
            for r in batch.to_pylist():
                if own and own[-1]["message_id"] != r["message_id"]:
                    out.append(fold_(own))
                    own = []
                own.append(r)
            yield pa.RecordBatch.from_pylist([r for r in out if r], schema=schema)
        if own and (last := fold_(own)):
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    dealt = records.repartition("message_id") if only is None else records  # flags come from windows by message, which dealt the rows
    return dealt.sortWithinPartitions("message_id", "pos").mapInArrow(run, records.select(kept).schema)


def contributions(records: DataFrame) -> DataFrame:
    """The effective record of each message. Messages without a live update need no fold: an exclusion takes them away,
    else the last exact record counts, else the last one."""
    of = Window.partitionBy("message_id")
    known = records.filter("message_id is not null").withColumn("__live", F.max(F.col("update").isNotNull()).over(of))
    gone = F.coalesce(F.col("scope").isin(EXCLUDED_ITEM, EXCLUDED_SESSION), F.lit(False))
    plain = known.filter("not __live").withColumn("__gone", F.max(gone).over(of)).filter("not __gone")
    best = precedence.best(plain, ["message_id"], precedence.is_exact().desc(), F.col("pos").desc())
    return best.select(*records.columns).unionByName(by_message(known.filter("__live").select(*records.columns), fold))


def history(records: DataFrame) -> DataFrame:
    """The history after all upserts, from one reading and one shuffle of the records. Only messages with a live update among several records need a fold: for the others
    quality, completeness, freshness and arrival are a total order, and what the losers lend follows from their order."""
    of = Window.partitionBy("message_id")
    live = F.max(F.col("update").isNotNull()).over(of)
    known = records.filter("message_id is not null").withColumn("__n", F.count("*").over(of)).withColumn("__live", (F.col("__n") > 1) & live)
    plain = _plain_history(known, F.col("__live") | (F.col("__n") == 1))
    return by_message(plain.select(*records.columns, "__live"), fold_history, "__live")


def _plain_history(records: DataFrame, as_is: Column) -> DataFrame:
    """`fold_history` of messages without live updates, by windows in order of arrival; all records of messages that are left `as_is`.

    A record wins if none before it has a higher rank. The last winner stays, at the place of the first record. Its agent is that of the
    last winner that has one, else the first agent; evidence is put together in order.
    """
    fresh = F.coalesce(F.greatest(*(c for c in ("start", "first_token", "completed") if c in records.columns), F.lit(float("-inf"))), F.lit(0.0))
    rank = F.struct(precedence.is_exact().alias("exact"), precedence.completeness(records.columns).alias("complete"), F.when(fresh == float("-inf"), 0.0).otherwise(fresh).alias("fresh"))
    arrival = Window.partitionBy("message_id").orderBy("pos")
    before, all_ = arrival.rowsBetween(Window.unboundedPreceding, -1), arrival.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = records.withColumn("__rank", rank)
    highest = F.max("__rank").over(before)
    judged = ranked.withColumn("__wins", highest.isNull() | (F.col("__rank") >= highest)).withColumn("__at", F.row_number().over(arrival))
    taken = {"pos": F.first("pos").over(all_), "__last": F.max(F.when(F.col("__wins"), F.col("__at"))).over(all_)}
    taken["agent"] = F.coalesce(F.last(F.when(F.col("__wins"), F.col("agent")), True).over(all_), F.first("agent", True).over(all_))
    if "scope" in records.columns:
        has = lambda kind: F.max(F.coalesce(F.col("scope") == kind, F.lit(False))).over(all_)
        known = F.last(F.when(F.col("scope") != PENDING, F.col("scope")), True).over(all_)
        taken["scope"] = F.when(has(EXCLUDED_SESSION), EXCLUDED_SESSION).when(has(EXCLUDED_ITEM), EXCLUDED_ITEM).otherwise(F.coalesce(known, F.first("scope", True).over(all_)))
    if "scope_reasons" in records.columns:
        taken["scope_reasons"] = F.array_distinct(F.flatten(F.collect_list(F.coalesce("scope_reasons", F.array().cast("array<string>"))).over(all_)))
        taken["scope_parent"] = F.last("scope_parent", True).over(all_)
    own = lambda n, c: F.when(as_is, F.col(n)).otherwise(c) if n in records.columns else c
    merged = judged.select(*(c for c in judged.columns if c not in taken), *(own(n, c).alias(n) for n, c in taken.items()))
    return merged.filter(as_is | (F.col("__at") == F.col("__last"))).select(*records.columns)


def transition(rows: list[dict], measures: list[str]) -> dict:
    """What a ledger holds of one message after records came in. The first row is what it holds now, if `stored`.

    A mark without a body (`legacy`) is counted and can't change, excluded ones stay out for good. A provisional record never replaces
    an exact one; an update must be newer than the held one's; a record without it yields to a held update of its quality and to a
    backfilled one. What says the same changes nothing, a settled one stays settled; anything else opens the message again.
    """
    held = rows[0] if rows[0]["stored"] else None
    for r in rows[held is not None :]:
        if r["scope"] in (EXCLUDED_ITEM, EXCLUDED_SESSION):
            if held and not held["legacy"]:
                held = held | {"excluded": True, "status": "settled"}
            else:
                held = (held or r) | {"excluded": True, "status": "settled", "legacy": True}
            continue
        if held and (held["legacy"] or held["excluded"]):
            continue
        new = r | {"quality": r["quality"] or "exact", "status": "open", "legacy": False, "excluded": False, "backfill": False}
        if held:
            if held["quality"] == "exact" and new["quality"] == "provisional":
                continue
            if new["update"]:
                if held["update"] and not is_newer(new["update"], held["update"]):
                    continue
            elif held["backfill"] or (held["update"] and held["quality"] == new["quality"]):
                continue
            if all(held[c] == new[c] for c in ("session_id", "quality", "update", *measures)):
                continue
        held = new
    return held


def applied(stored: DataFrame, records: DataFrame, measures: list[str]) -> tuple[DataFrame, DataFrame]:
    """A ledger's contributions after records came in, and (session_id, calls, measures), what its session sums change by.

    `stored` has message_id, session_id, status, quality, measures, update, legacy, excluded and backfill; `records` message_id,
    session_id, quality, measures, update, scope and pos. Only messages that records name are folded, a few rows each.
    """
    told = records.filter("message_id is not null")
    flag = lambda value: F.lit(value).cast("boolean")
    none = F.lit(None).cast("string")
    columns = ["message_id", "session_id", "status", "quality", *measures, "update", "legacy", "excluded", "backfill", "scope", "pos", "stored"]
    new = told.withColumns({"status": none, "legacy": flag(False), "excluded": flag(False), "backfill": flag(False), "stored": flag(False)}).select(columns)
    place = new.schema["pos"].dataType
    held = stored.join(told.select("message_id").distinct(), "message_id", "left_semi").withColumns({"scope": none, "pos": F.lit(None).cast(place), "stored": flag(True)}).select(columns)
    after = by_message(held.unionByName(new), lambda rows: transition(rows, measures))
    kept = ["message_id", "session_id", "status", "quality", *measures, "update", "legacy", "excluded", "backfill"]
    whole = stored.join(told.select("message_id").distinct(), "message_id", "left_anti").select(kept).unionByName(after.select(kept))
    counted = lambda rows, sign: rows.filter("not legacy and not excluded").select("session_id", F.lit(sign).cast("long").alias("calls"), *((sign * F.col(m)).alias(m) for m in measures))
    sums = counted(after, 1).unionByName(counted(held, -1)).groupBy("session_id").agg(*(F.sum(c).alias(c) for c in ("calls", *measures)))
    some = F.col("calls") != 0
    for m in measures:
        some = some | (F.col(m) != 0)
    return whole, sums.filter(some)


def newer(a: Column, b: Column) -> Column:
    """`is_newer` of two update structs, of which `a` is there, as an expression."""
    fresh = (a["revision"] != b["revision"]) & a["revision"].isNotNull() & b["revision"].isNotNull()
    replay = a["fingerprint"].isNotNull() & (F.coalesce(a["fingerprint"] == b["fingerprint"], F.lit(False)) | F.coalesce(F.array_contains(b["seen"], a["fingerprint"]), F.lit(False)))
    zero = lambda x, f: F.coalesce(x[f], F.lit(0.0))
    order = F.when(a["instance"].eqNullSafe(b["instance"]), zero(a, "sequence") > zero(b, "sequence")).otherwise(zero(a, "received_at") >= zero(b, "received_at"))
    return F.when(b.isNull(), True).when(F.coalesce(fresh, F.lit(False)), a["revision"] > b["revision"]).when(replay, False).otherwise(order)


def ledger_union(copies: DataFrame, baselines: DataFrame, measures: list[str]) -> DataFrame:
    """(session_id, measures): sums of several ledgers where a message that more than one holds counts once.

    `baselines` (session_id, measures) are the ledgers' session sums, `copies` their messages with ledger, session_id,
    quality, excluded, update (may be null), measures (signed as they entered the sums) and, if the ledgers have it, legacy:
    a settled message without a body. All copies of a shared message are taken out and the winner put back. Excluded copies
    shut the others out, then exact ones do. The winner must equal or supersede each other one: by an update that is newer
    while the other's is not newer in turn, or by having one at all. If none does, or a legacy copy is shared, the ledgers
    can't be united, which is an error.
    """
    if "legacy" not in copies.columns:
        copies = copies.withColumn("legacy", F.lit(False))
    value = F.struct("session_id", *measures)
    exact = F.coalesce("quality", F.lit("exact")) == "exact"
    copy = F.struct("excluded", exact.alias("exact"), "update", F.when(~F.col("excluded"), value).alias("value"), "legacy")
    # one copy a ledger, so a list is as long as there are ledgers
    held = copies.groupBy("message_id").agg(F.countDistinct("ledger").alias("n"), F.collect_list(copy).alias("copies")).filter("n > 1")
    strict = lambda rows, test: F.when(F.exists(rows, test), F.filter(rows, test)).otherwise(rows)
    shut = held.withColumn("left", strict(F.col("copies"), lambda c: c["excluded"])).withColumn("left", strict(F.col("left"), lambda c: c["exact"]))

    def beats(x: Column, y: Column) -> Column:
        both = x["update"].isNotNull() & y["update"].isNotNull()
        return F.when(both, newer(x["update"], y["update"]) & ~newer(y["update"], x["update"])).otherwise(x["update"].isNotNull() & y["update"].isNull())

    def winners() -> Column:
        rows = F.col("left")
        out = F.filter(rows, lambda x: F.forall(rows, lambda y: x["value"].eqNullSafe(y["value"]) | beats(x, y)))
        return out

    won = shut.withColumn("won", winners())
    latest = F.filter("won", lambda x: ~F.exists("won", lambda y: beats(y, x)))
    pick = F.element_at(F.array_sort(F.transform(F.when(F.size(latest) > 0, latest).otherwise(F.col("won")), lambda x: x["value"])), 1)
    bad = F.exists("copies", lambda c: c["legacy"]) | (F.size("won") == 0)
    picked = won.select(F.when(bad, F.raise_error(F.lit("copies of one message can't be merged"))).otherwise(pick).alias("v"), "copies")
    back = picked.filter("v is not null").select("v.*")
    taken = picked.select(F.explode("copies").alias("c")).filter("not c.excluded").select("c.value.session_id", *((-F.col(f"c.value.{m}")).alias(m) for m in measures))
    return baselines.select("session_id", *measures).unionByName(taken).unionByName(back).groupBy("session_id").agg(*(F.sum(m).alias(m) for m in measures))


def overlay(totals: DataFrame, contributions: DataFrame, records: DataFrame, measures: list[str]) -> DataFrame:
    """Ledger sums plus records that the ledger lacks, and the difference for those that it holds with other values; clamped once."""
    old = contributions.select("message_id", F.col("session_id").alias("old_session"), *(F.col(m).alias(f"old_{m}") for m in measures))
    met = records.join(old, "message_id", "left")
    terms = met.select("session_id", *measures).unionByName(met.filter("old_session is not null").select(F.col("old_session").alias("session_id"), *((-F.col(f"old_{m}")).alias(m) for m in measures)))
    summed = totals.select("session_id", *measures).unionByName(terms).groupBy("session_id")
    return summed.agg(*(F.greatest(F.sum(m), F.lit(0)).alias(m) for m in measures))


def retired(optimistic: DataFrame, contributions: DataFrame) -> DataFrame:
    """Optimistic copies that the ledger has not confirmed yet, with the same or a later revision."""
    known = contributions.select("message_id", F.col("revision").alias("known"))
    met = optimistic.join(known, "message_id", "left")
    return met.filter(F.col("known").isNull() | (F.col("revision") > F.col("known"))).select(*optimistic.columns)


def frozen(contributions: DataFrame, retained: DataFrame) -> DataFrame:
    """Contributions with their status: exact ones outside the retained messages are settled, the others open; sums don't change."""
    inside = retained.select("message_id", F.lit(True).alias("held")).distinct()
    exact = F.coalesce("quality", F.lit("exact")) == "exact"
    status = F.when(exact & F.col("held").isNull(), "settled").otherwise("open")
    return contributions.join(inside, "message_id", "left").withColumn("status", status).drop("held")


def tombstones(contributions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contributions with `excluded` set where evidence (message_id, reasons) excludes them, their amounts kept so that they can
    be told from others and the proof beside them; and (message_id, reasons) of evidence on messages that no contribution
    with a body is known of, which later keeps them out. Exclusion is for good."""
    proof = evidence.groupBy("message_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("proof"))
    met = contributions.join(proof, "message_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)) | F.col("proof").isNotNull())
    known = contributions.filter("not legacy") if "legacy" in contributions.columns else contributions
    unknown = proof.join(known.select("message_id"), "message_id", "left_anti").select("message_id", F.col("proof").alias("reasons"))
    return met, unknown
