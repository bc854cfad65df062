"""Content progress as a stream: the state of a response is a row of values and a map of its parts, none of them texts.

A part's text so far is held as its length and a remainder: the bytes as one large number modulo a prime. Appending is one
multiplication, however the text was cut, so what was received can be compared with a snapshot, and so can what was received but
for white space at its end. Rows that come out are those of `operators.content.progress`; the last one of a response counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.content import CONTENT, TRUSTED_CLOCK, WHITE

PRIME = (1 << 255) - 19
SPACE = "".join(map(chr, WHITE))
KINDS = ("output", "reasoning")
SCHEMA = (
    "message_id string, from_start boolean, steps array<string>, first_receive double, last_receive double, start double, end double, observations bigint, clock_trusted boolean, "
    "clock_resolution_ms double, streams array<string>, output_bytes bigint, output_first bigint, reasoning_bytes bigint, reasoning_first bigint, content_parts bigint, tool_parts boolean, "
    "unshown boolean, gap string, untimed boolean, output_sent bigint, reasoning_sent bigint, taints array<string>"
)


def appended(held: tuple[int, int], text: str) -> tuple[int, int]:
    """(length, remainder) of a text after more of it."""
    data = text.encode()
    return held[0] + len(data), (held[1] * pow(256, len(data), PRIME) + int.from_bytes(data, "big")) % PRIME


def _valid(x: Any) -> bool:
    return x is not None and 0 <= x < float("inf")


def _kind(part_type: str) -> str:
    return "reasoning" if part_type == "reasoning" else "output"


class ContentState(StatefulProcessor):
    """Folds a response's observations in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.whole = handle.getValueState("whole", "state string")
        self.parts = handle.getMapState("parts", "part string", "state string")
        self.events = handle.getMapState("events", "event string", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.whole.get()[0]) if self.whole.exists() else {"from_start": False, "steps": [], "streams": [], "taints": [], "receive": None, "arrived": False}
        parts = {k[0]: json.loads(v[0]) for k, v in self.parts.iterator()}
        taints, touched = set(state["taints"]), set()
        for r in (json.loads(x) for x in pd.concat(list(rows)).sort_values("pos")["row"]):
            self._note(r, state, parts, taints, touched)
        state["taints"] = sorted(taints)
        for p in touched:
            self.parts.updateValue((p,), (json.dumps(parts[p]),))
        self.whole.update((json.dumps(state),))
        yield self._row(key[0], state, parts)

    def _note(self, r: dict, state: dict, parts: dict, taints: set, touched: set) -> None:
        kind, name = r["kind"], r["part_id"]
        if kind == "begin":
            state["from_start"] = state["from_start"] or bool(r["from_start"])
        elif kind == "taint":
            taints.add((r["reason"] or "").strip(" ") or "unknown-coverage")
        if kind == "step" or (kind == "snapshot" and r["step_id"] is not None):
            if not (r["step_id"] or "").strip(" "):
                taints.add("unknown-step-identity")
            elif r["step_id"] not in state["steps"]:
                state["steps"] = sorted([*state["steps"], r["step_id"]])
        if kind == "snapshot":
            self._snapshot(r, parts, taints, touched)
        elif kind == "delta" and r["text"]:
            if r["event_id"] is not None:
                if self.events.containsKey((r["event_id"],)):
                    return
                self.events.updateValue((r["event_id"],), (True,))
            if r["stream"] is not None and r["stream"] not in state["streams"]:
                state["streams"] = sorted([*state["streams"], r["stream"]])
            if name is None:
                taints.add("anonymous-delta")
            if r["part_type"] == "tool":
                taints.add("tool-usage-uncertain")
            part = parts.setdefault(name, self._new()) if name is not None else None
            if part is not None:
                touched.add(name)
                part["sent_type"] = part["sent_type"] or r["part_type"]
                kept = r["text"].rstrip(SPACE)
                if kept:
                    part["trimmed"] = appended(part["sent"], kept)
                part["sent"] = appended(part["sent"], r["text"])
            self._arrival(r, part, state, taints)

    def _snapshot(self, r: dict, parts: dict, taints: set, touched: set) -> None:
        if r["part_type"] == "tool":
            taints.add("tool-usage-uncertain")
        if r["part_id"] is None:
            taints.add("anonymous-snapshot")
            return
        part = parts.setdefault(r["part_id"], self._new())
        touched.add(r["part_id"])
        if None not in (part["sent_type"], r["part_type"]) and r["part_type"] != part["sent_type"]:
            part["changed"] = True
        part["shown_type"] = r["part_type"]
        if r["final"] and r["text"] is not None:
            part["final"] = appended((0, 0), r["text"])

    @staticmethod
    def _new() -> dict:
        return {"sent_type": None, "shown_type": None, "sent": (0, 0), "trimmed": (0, 0), "received": 0, "final": None, "changed": False}

    @staticmethod
    def _arrival(r: dict, part: dict | None, state: dict, taints: set) -> None:
        if part is None or r["part_type"] not in CONTENT:
            taints.add("anonymous-or-tool-arrival")
            return
        if not (_valid(r["received_at"]) and _valid(r["received_mono"])):
            taints.add("invalid-receive-clock")
            return
        state["arrived"] = True
        mono, size, got = r["received_mono"], len(r["text"].encode()), state["receive"]
        if got and mono < got["last"]:
            taints.add("nonmonotonic-receive-clock")
            return
        if not got:
            got = state["receive"] = {"first": mono, "last": mono, "start": r["received_at"], "end": None, "n": 1, "trusted": True, "resolution": None, "bytes": [0, 0], "batch": [0, 0]}
        resolution = r["clock_resolution_ms"]
        got["trusted"] = got["trusted"] and r["clock_source"] == TRUSTED_CLOCK and (resolution or 0) > 0
        got["resolution"] = max((x for x in (got["resolution"], resolution) if x is not None), default=None)
        got["n"] += mono > got["last"]
        got["last"], got["end"] = mono, r["received_at"]
        k = KINDS.index(_kind(r["part_type"]))
        part["received"] += size
        got["bytes"][k] += size
        if mono == got["first"]:
            got["batch"][k] += size

    @staticmethod
    def _row(message: str, state: dict, parts: dict) -> pd.DataFrame:
        got = state["receive"]
        typed = {p: (x["shown_type"] or x["sent_type"], x) for p, x in sorted(parts.items())}
        content = {p: x for p, (t, x) in typed.items() if t in CONTENT}
        sent = [sum(x["sent"][0] for t, x in typed.values() if t in CONTENT and _kind(t) == k) for k in KINDS]
        gaps = []
        for x in content.values():
            final = x["final"] and tuple(x["final"])
            if final and final != tuple(x["sent"]) and not (x["sent"][0] and final == tuple(x["trimmed"])):
                gaps.append("snapshot-delta-gap" if final[0] > x["sent"][0] else "snapshot-delta-mismatch")
        more = {"multiple-step-identities"} if len(state["steps"]) > 1 else set()
        more |= {"mixed-streams"} if len(state["streams"]) > 1 else set()
        more |= {"not-observed-from-current-start"} if state["arrived"] and not state["from_start"] else set()
        more |= {"part-kind-changed"} if any(x["changed"] for x in parts.values()) else set()
        of = lambda name: got[name] if got else None
        row = (
            message, state["from_start"], state["steps"], of("first"), of("last"), of("start"), of("end"), got["n"] if got else 0, bool(got and got["trusted"]), of("resolution"), state["streams"],
            *((got["bytes"][0], got["batch"][0], got["bytes"][1], got["batch"][1]) if got else (0, 0, 0, 0)), len(content), any(t == "tool" for t, _ in typed.values()),
            any(x["final"] is None for x in content.values()), gaps[0] if gaps else None, any(x["sent"][0] != x["received"] for x in content.values()), *sent, sorted(set(state["taints"]) | more),
        )
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def progress_stream(observations: DataFrame) -> DataFrame:
    """A stream of progress rows from one of observations; needs the RocksDB state store."""
    rows = observations.filter("message_id is not null").select("message_id", "pos", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    return rows.groupBy("message_id").transformWithStateInPandas(ContentState(), SCHEMA, "update", "None")
