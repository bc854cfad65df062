"""Host events to facts and responses.

Events are JSON texts (`value`, `pos`). The adapter is declarative: an event belongs to the last execution of its session that began
at or before it, which one window finds; steps and tools are then joined by their ids. So late and repeated events give the
same facts in any order of delivery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.leaves import Leaves, filled, whole_text
from ..operators import precedence

#: Types that carry content only, and types that the adapter reads.
CONTENT = r"^(message\.part\.(delta|updated)|session\.(next\.)?(text|reasoning)\..*|session\.(next\.)?tool\.(input\..*|progress))$"
CONTROL = r"^session\.(created|forked|metadata\.updated|agent\.selected|renamed|status|idle|execution\.(started|succeeded|failed|interrupted)|retry\.scheduled|step\.(started|ended|failed)|tool\.(called|success|failed))$"
#: The types that name a state, the keys under which an event may carry one and the places where it may, and
#: the words for each state in order of priority.
TYPE_STATES = {
    "session.idle": "idle", "session.error": "failed", "session.abort": "aborted", "session.aborted": "aborted", "session.cancel": "cancelled", "session.cancelled": "cancelled",
    "session.stop": "stopped", "session.stopped": "stopped", "session.completed": "completed", "session.next.retried": "retry", "session.next.step.failed": "failed",
}
STATUS_KEYS = ["status", "state", "type", "name"]
STATUS_PLACES = ["properties", "", "properties.info", "properties.session", "properties.event", "info", "session", "event"]
WORD_STATES = [("busy", ["busy"]), ("retry", ["retry"]), ("idle", ["idle"]), ("completed", ["completed", "complete", "done"]), ("failed", ["failed", "failure", "error"]), ("aborted", ["aborted", "abort"]), ("cancelled", ["cancelled", "canceled", "cancel"]), ("stopped", ["stopped", "stop"])]
def everywhere(*names: str, inside: tuple[str, ...] = ("", "properties.")) -> list[str]:
    return [f"{where}{name}" for name in names for where in inside]


def is_content(kind: Column) -> Column:
    return kind.rlike(CONTENT)


def is_control(kind: Column) -> Column:
    return kind.rlike(CONTROL)


def is_replay(leaves: Leaves) -> Column:
    """Marked as a replay, or from a snapshot: never live evidence."""
    marked = [F.coalesce(leaves.flag(p), F.lit(False)) for p in ("replay", "properties.replay")]
    source = [F.coalesce(leaves.text(p), F.lit("")).isin("snapshot", "history", "reconnect") for p in ("source", "properties.source")]
    return marked[0] | marked[1] | source[0] | source[1]


def is_completed(leaves: Leaves) -> Column:
    """Said to be completed by a flag, a status or an end."""
    out = leaves.number("properties.info.time.end").isNotNull() | leaves.number("properties.info.time.completed").isNotNull()
    for p in ("properties.info.", "properties.", ""):
        word = F.coalesce(leaves.text(f"{p}completed"), leaves.text(f"{p}status"), leaves.text(f"{p}status.type"), F.lit(""))
        out = out | F.coalesce(leaves.flag(f"{p}completed"), F.lit(False)) | (word == "completed")
    return out


def session_of(leaves: Leaves, kind: Column) -> Column:
    """The session an event belongs to, under all of its names; the id of an info object only for session events."""
    direct = leaves.first_text(*everywhere("sessionID", "sessionId", "session.id", inside=("properties.", "")), *everywhere("sessionID", "sessionId", inside=("properties.part.", "part.", "properties.session.", "properties.info.", "info.")))
    own = F.when(kind.startswith("session."), leaves.first_text("properties.info.id", "info.id"))
    return F.coalesce(direct, own, F.when(kind.isin("session.created", "session.updated"), leaves.first_text("properties.id", "id")))


def parent_of(leaves: Leaves, kind: Column) -> Column:
    """The parent session: by an explicit name, else the parent of a session entity; never the parent of a message."""
    where = ("properties.", "", "properties.info.", "properties.message.", "info.", "message.")
    explicit = leaves.first_text(*everywhere("parentSessionID", "parentSessionId", inside=where))
    entity = leaves.first_text(*everywhere("parentID", "parent.id", inside=("properties.session.", "session.", "properties.info.session.")))
    own = F.when(kind.isin("session.created", "session.updated"), leaves.first_text(*everywhere("parentID", "parent.id", inside=("properties.", "", "properties.info.", "info."))))
    return F.coalesce(explicit, entity, own)


def status_words(leaves: Leaves, places: list[str]) -> Column:
    """The texts at `status` and `state` of these places, and in objects there those under `STATUS_KEYS`, however deep.

    A row takes as many steps as its status has opening braces, so none is too deep.
    """
    said = F.array(*(leaves.raw(f"{p}.{key}" if p else key) for p in places for key in ("status", "state")))
    return F.transform(_words(F.filter(said, lambda x: x.isNotNull())), F.lower)


def _words(values: Column) -> Column:
    texts = lambda level: F.filter(F.transform(level, whole_text), lambda x: x.isNotNull())
    objects = lambda level: F.filter(level, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    inner = lambda x: F.filter(F.array(*(F.try_variant_get(x, f"$.{key}", "variant") for key in STATUS_KEYS)), lambda y: y.isNotNull())
    step = lambda held, _: F.struct(F.flatten(F.transform(objects(held["level"]), inner)).alias("level"), F.concat(held["words"], texts(held["level"])).alias("words"))
    braces = F.aggregate(values, F.lit(0), lambda n, x: n + F.size(F.split(F.to_json(x), r"\{")) - 1)
    start = F.struct(values.alias("level"), F.array().cast("array<string>").alias("words"))
    return F.aggregate(F.sequence(F.lit(0), braces), start, step, lambda held: held["words"])


def lifecycle_state(kind: Column, words: Column) -> Column:
    """The state that an event's type names, else, for status events, the one its words name; none for any other type."""
    low = F.lower(kind)
    by_type = F.lit(None).cast("string")
    for name, state in TYPE_STATES.items():
        by_type = F.when(low == name, state).otherwise(by_type)
    by_word = F.lit(None).cast("string")
    for state, names in reversed(WORD_STATES):
        by_word = F.when(F.arrays_overlap(words, F.array(*(F.lit(n) for n in names))), state).otherwise(by_word)
    return F.coalesce(by_type, F.when(low.endswith(".status"), by_word))


def older_facts(events: DataFrame) -> DataFrame:
    """Lifecycle and parent facts of the older kind of events."""
    leaves = Leaves()
    kind = leaves.text("type")
    columns = {
        "type": kind,
        "session_id": session_of(leaves, kind),
        "parent_id": parent_of(leaves, kind),
        "words": F.when(F.lower(kind).endswith(".status"), status_words(leaves, STATUS_PLACES)),
        "ts": leaves.number("timestamp"),
        "event_id": leaves.text("id"),
        "replay": is_replay(leaves),
    }
    read = leaves.over(events).filter(~is_content(kind)).select(*(c.alias(n) for n, c in columns.items()), "pos").filter("session_id is not null and ts is not null")
    rows = read.withColumn("state", lifecycle_state(F.col("type"), F.col("words")))
    none = F.lit(None).cast("string")
    fact = lambda name, parent, state: F.struct(F.lit(name).alias("kind"), "session_id", parent.alias("parent_id"), state.alias("state"), "ts", "event_id", "pos")
    lifecycle = F.when(F.col("state").isNotNull() & ~F.col("replay"), fact("lifecycle", none, F.col("state")))
    parent = F.when(F.col("parent_id").isNotNull(), fact("parent", F.col("parent_id"), none))
    return rows.select(F.explode(F.filter(F.array(lifecycle, parent), lambda x: x.isNotNull())).alias("f")).select("f.*")


def fields(events: DataFrame, usage: bool = False) -> DataFrame:
    """What facts need of the newer kind of events or, with `usage`, what responses need of steps. An event delivered twice counts
    once, the first to come. Rows leave dealt by session (with `usage`: by session and message), so that windows over these
    shuffle nothing again."""
    leaves = Leaves()
    data = lambda p: leaves.text(f"data.{p}")
    kind = leaves.text("type")
    columns = {
        "type": kind,
        "event_id": leaves.text("id"),
        "ts": leaves.number("created"),
        "source_sequence": leaves.number("durable.seq").cast("long"),
        "session_id": filled(data("sessionID")),
        "message_id": data("assistantMessageID"),
        "tool_id": data("id"),
        "started": leaves.number("data.started"),
    }
    if usage:
        columns |= {"agent": data("agent"), "model": data("model.id"), "billed": leaves.raw("data.tokens").isNotNull(), "cost": leaves.number("data.cost")}
        columns |= {f"said_{n}": c for n, c in zip(tokens.ALIASES, tokens.said(leaves.number, "data.tokens."), strict=True)}
        wanted, keys = kind.startswith("session.step.") & columns["message_id"].isNotNull(), ["session_id", "message_id"]
    else:
        columns |= {"words": F.when(F.lower(kind).endswith(".status"), status_words(leaves, ["data"])), "parent_id": leaves.first_text("data.parentID", "data.parentSessionID")}
        wanted, keys = F.lit(True), ["session_id"]
    read = leaves.over(events).filter(is_control(kind) & wanted).select(*(c.alias(n) for n, c in columns.items()), "pos").filter("session_id is not null")
    return precedence.best(read.repartition(*keys), ["session_id", "message_id", "event_id", "type", "tool_id", "ts"], F.col("pos"))


def with_execution(rows: DataFrame) -> DataFrame:
    """`execution_id`: the last execution begun at or before the event; without one the session's events share a partial one."""
    began = F.when(F.col("type") == "session.execution.started", F.col("event_id"))
    at = Window.partitionBy("session_id").orderBy(F.col("source_sequence").asc_nulls_first(), "ts", F.col("type") != "session.execution.started", "event_id")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("execution_id", F.coalesce(F.last(began, ignorenulls=True).over(upto), F.concat(F.lit("partial:"), "session_id")))


#: The states that these types name.
ENDS = {"session.execution.succeeded": "completed", "session.execution.failed": "failed", "session.execution.interrupted": "aborted", "session.execution.started": "busy", "session.retry.scheduled": "retry", "session.idle": "idle"}


def newer_facts(events: DataFrame) -> DataFrame:
    """Lifecycle, parent and work facts of the newer kind of events. A tool belongs to the execution of its step. An event's facts
    are told in one pass, after the windows that find its execution and its step's."""
    kind, none = F.col("type"), F.lit(None).cast("string")
    begun = F.when((kind == "session.step.started") & F.col("message_id").isNotNull(), F.struct("ts", "execution_id"))
    owner = F.min(begun).over(Window.partitionBy("session_id", "message_id")).getField("execution_id")
    rows = with_execution(fields(events)).withColumn("owner", owner)
    state = lifecycle_state(kind, F.col("words"))
    for name, word in ENDS.items():
        state = F.when(kind == name, word).otherwise(state)
    rows = rows.withColumn("state", F.when(kind.isin("session.status", *ENDS), state))

    def fact(name: str, **values: Column) -> Column:
        own = {"ts": F.col("ts"), "execution_id": F.col("execution_id")} | values
        columns = ("ts", "execution_id", "state", "parent_id", "work_id", "source", "phase", "step_id")
        return F.struct(F.lit(name).alias("kind"), "session_id", "event_id", "source_sequence", "pos", *(own.get(c, none).alias(c) for c in columns))

    is_step = kind.startswith("session.step.") & F.col("message_id").isNotNull()
    is_tool = kind.startswith("session.tool.") & F.col("tool_id").isNotNull()
    work = fact(
        "work",
        ts=F.when(kind == "session.step.started", F.coalesce("started", "ts")).otherwise(F.col("ts")),
        execution_id=F.coalesce("owner", "execution_id"),
        work_id=F.when(is_step, F.col("message_id")).otherwise(F.col("tool_id")),
        source=F.when(is_step, "step").otherwise("tool"),
        phase=F.when(kind.isin("session.step.started", "session.tool.called"), "start").otherwise("end"),
        step_id=F.when(is_tool, F.col("message_id")),
    )
    told = [
        F.when(F.col("state").isNotNull(), fact("lifecycle", state=F.col("state"))),
        F.when(F.col("parent_id").isNotNull(), fact("parent", parent_id=F.col("parent_id"))),
        F.when(is_step | is_tool, work),
    ]
    return rows.select(F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("f")).select("f.*")


def newer_responses(events: DataFrame) -> DataFrame:
    """Responses of ended steps, with the start that their beginning named. A failed step without usage is no call. A
    response is exact if input and output were reported and reasoning was, or is zero."""
    rows = fields(events, usage=True).withColumn("tokens", tokens.counters()).withColumn("reported", tokens.partial(F.col("tokens")))
    of, begun = Window.partitionBy("session_id", "message_id"), F.col("type") == "session.step.started"
    first = {"start": F.min(F.when(begun, F.coalesce("started", "ts"))), "agent0": F.max(F.when(begun, F.col("agent"))), "model0": F.max(F.when(begun, F.col("model")))}
    ends = rows.withColumns({n: c.over(of) for n, c in first.items()}).filter("type = 'session.step.ended' or (type = 'session.step.failed' and billed)")
    said = F.col("reported.input").isNotNull() & F.col("reported.output").isNotNull() & (F.col("reported.reasoning").isNotNull() | (F.col("tokens.reasoning") == 0))
    quality = F.when(said, "exact").otherwise("provisional")
    return ends.select("message_id", "session_id", F.coalesce("agent", "agent0").alias("agent"), F.coalesce("model", "model0").alias("model"), quality.alias("quality"), *(F.col(f"tokens.{c}").alias(c) for c in ("input", "output", "reasoning", "cache_read", "cache_write")), F.coalesce("cost", F.lit(0.0)).alias("cost"), "start", F.col("ts").alias("completed"), F.col("source_sequence").alias("revision"), "pos")


def idle_provisional(unfinished: DataFrame, facts: DataFrame) -> DataFrame:
    """Unfinished responses of sessions that went inactive at or after their start, as provisional records ended at the first
    such time, which one window over both finds."""
    ended = facts.filter("kind = 'lifecycle' and state not in ('busy', 'retry')").select("session_id", F.col("ts").alias("__at"), F.col("ts").alias("__ended"), F.lit(None).cast(unfinished.schema).alias("__row"))
    open_ = unfinished.select("session_id", F.col("start").alias("__at"), F.lit(None).cast(facts.schema["ts"].dataType).alias("__ended"), F.struct("*").cast(unfinished.schema).alias("__row"))
    on = Window.partitionBy("session_id").orderBy("__at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    met = open_.unionByName(ended).withColumn("__first", F.min("__ended").over(on)).filter("__row is not null and __first is not null")
    return met.select("__row.*", "__first").drop("completed", "quality").withColumnRenamed("__first", "completed").withColumn("quality", F.lit("provisional"))
