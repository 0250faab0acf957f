"""A two-round replay session (C10): resolve, review, freeze, compute, compute again from what was frozen, compare.

The session lives in its folder and not in the object that drives it. Every step writes its tables under a name of its own and
then appends one entry to the log: the state it leads to, and where its tables are. An entry has the next number, and counts
only if its writer alone claimed that number (``RunStore``), so two drivers can't both go on from one state. The state
is what folding the log gives; a fresh driver that resumes reads the log, goes on from there, and finds the tables of steps that
were done. Tables of a step whose driver died before its entry are never looked at.

A session that has nothing to review goes through the state of awaiting a review too, so every step is one that the
table's gate allows. Freezing what still waits, or a second round that isn't one, fails it for good."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field


import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeline.errors import CheckViolation, ForeignKeyViolation, RunExists, SessionConflict, SessionError
from gaugeline.operators import channels as C
from gaugeline.operators import exact, gates, replay
from gaugeline.operators import resolution as N
from gaugeline.plans.config import COMPARISON_CONTRACT, PIPELINE_VERSION, manifest_hash
from gaugeline.plans.report import Relations
from gaugeline.sources.store import RunStore

__all__ = ["ReplaySession", "SessionConflict", "SessionError", "folded"]

PARTS = ("runs", "videos", "channels", "artists", "names")
OPEN = gates.SESSION_STATES[0]
DIGESTS = "session_id string, round int, report_id string, digest string"


def folded(entries: DataFrame) -> DataFrame:
    """C10, C11 as a fold over logs: entries (session_id, seq, state) in order, each with whether it is accepted and the state after it.

    A step that the state before it doesn't allow changes nothing, and the first state must be the open one. Rows stream through
    sorted by session and number; one state is held."""
    names = entries.columns
    schema = StructType([*entries.schema.fields, *StructType.fromDDL("accepted boolean, state_after string").fields])
    allowed = set(gates.session_transitions())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            accepted, after = [], []
            for session, to in zip(batch.column(names.index("session_id")).to_pylist(), batch.column(names.index("state")).to_pylist(), strict=True):
                if session != now:
                    now, state = session, None
                accepted.append((state, to) in allowed)
                state = to if accepted[-1] else state
                after.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(after, pa.string())], [*names, "accepted", "state_after"])

    return entries.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(fold, schema)


@dataclass
class ReplaySession:
    """One session over a source run. ``reports`` are the ids of the reports that it binds, each with its run.

    A new one opens a session; ``resume`` takes up one that is there, wherever it stands."""

    spark: SparkSession
    folder: str
    session_id: str
    source_run_id: str
    reports: dict[str, str]
    engine_name: str = "gaugeline"
    _seen: list[dict] | None = field(default=None, init=False, repr=False)

    def _log(self) -> RunStore:
        return RunStore(self.spark, f"{self.folder}/{self.session_id}/log")

    def entries(self) -> list[dict]:
        """The log in order: a few entries a session, read once, as whoever appends by an old one is refused."""
        if self._seen is None:
            store = self._log()
            self._seen = [] if store.manifest().isEmpty() else [json.loads(r.entry) for r in store.read().orderBy("seq").collect()]
        return self._seen

    def _append(self, state: str, **more: object) -> None:
        entry, seq = {"state": state, **more}, len(self.entries())
        row = self.spark.createDataFrame([(f"entry-{seq:06d}", seq, json.dumps(entry))], "run_id string, seq int, entry string")
        try:
            self._log().write(row)
        except RunExists as error:
            self._seen = None
            raise SessionConflict("another driver took this step", session_id=self.session_id, seq=seq) from error
        self.entries().append(entry)

    @property
    def state(self) -> str:
        """Folded from the log; the open state for a session without one."""
        state = OPEN
        for entry in self.entries():
            if entry["state"] != state:
                if (state, entry["state"]) not in gates.session_transitions():
                    raise SessionError(f"the log steps from {state} to {entry['state']}")
                state = entry["state"]
        return state

    def _said(self, name: str) -> object:
        """What the log last said under a name, or None."""
        return next((e[name] for e in reversed(self.entries()) if name in e), None)

    def _go(self, *to: str, **more: object) -> None:
        """Appends steps, the first with what else there is to say."""
        state = self.state
        for k, step in enumerate(to):
            if (state, step) not in gates.session_transitions() and step != state:
                raise SessionError(f"no step from {state} to {step}")
            self._append(step, **(more if k == 0 else {}))
            state = step

    def _in(self, *states: str) -> None:
        if (state := self.state) not in states:
            raise SessionError(f"not in {state}")

    def _frozen(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/{self.session_id}/{name}-{uuid.uuid4().hex}"
        replay.freeze(rows, path)
        return path

    def _table(self, name: str) -> DataFrame | None:
        path = self._said(name)
        return None if path is None else self.spark.read.parquet(str(path))

    @classmethod
    def resume(cls, spark: SparkSession, folder: str, session_id: str) -> ReplaySession:
        """The session as its log has it; its input must have been frozen."""
        found = cls(spark, folder, session_id, "", {})
        if (opened := found._said("opened")) is None:
            raise SessionError("no such session", session_id=session_id)
        return cls(spark, folder, session_id, opened["source_run_id"], opened["reports"], opened["engine_name"])

    @property
    def relations(self) -> Relations:
        if self._said("videos") is None:
            raise SessionError("the input isn't frozen")
        return Relations(**{n: self._table(n) for n in PARTS})

    @property
    def outcomes(self) -> DataFrame:
        return self._table("outcomes")

    @property
    def digests(self) -> list[tuple[str, int, str, str]]:
        """The evidence of the rounds that were computed."""
        return [(self.session_id, n, report, digest) for n in (1, 2) for report, digest in sorted((self._said(f"round{n}") or {}).items())]

    def freeze_input(self, r: Relations) -> Relations:
        """The relations as both rounds will read them. Opens the session; once."""
        if self.entries():
            raise SessionError("the session is open already")
        paths = {n: self._frozen(getattr(r, n), n) for n in PARTS}
        self._append(OPEN, opened={"source_run_id": self.source_run_id, "reports": self.reports, "engine_name": self.engine_name}, **paths)
        return self.relations

    def resolve(self) -> DataFrame:
        """The outcomes of round 1; gives those that wait for people."""
        self._in(OPEN)
        r = self.relations
        path = self._frozen(N.resolve(r.videos, r.names), "outcomes")
        waiting = self.spark.read.parquet(path).where("needs_review")
        self._go("r1_awaiting_review", *(["r1_resolved"] if waiting.isEmpty() else []), outcomes=path)
        return waiting

    def review(self, decisions: DataFrame) -> None:
        """people's decisions on all that waits; nothing may be left out, or decided that doesn't wait."""
        self._in("r1_awaiting_review")
        waiting, key = self.outcomes.where("needs_review"), ["run_id", "video_id"]
        gates.assert_empty(decisions.select(*key).join(waiting.select(*key), key, "left_anti"), "only what waits is decided", ForeignKeyViolation)
        gates.assert_empty(waiting.select(*key).join(decisions.select(*key), key, "left_anti"), "every waiting title is decided", CheckViolation)
        self._go("r1_resolved", reviewed=self._frozen(replay.apply_review(waiting, decisions), "reviewed"))

    def freeze(self) -> None:
        """The facts that round 2 replays."""
        names = ["run_id", "video_id", "method", "candidate", "decision", "final_name", "reason_code", "artist_id"]
        outcomes, reviewed = self.outcomes, self._table("reviewed")
        if self.state == "r1_awaiting_review":
            # A driver that ended between the two steps of a session with nothing to review left it here.
            if not outcomes.where("needs_review").isEmpty():
                self._go("failed")
                raise SessionError("titles still wait for a review")
            self._go("r1_resolved")
        self._in("r1_resolved")
        facts = outcomes.where("NOT needs_review").select(*names)
        if reviewed is not None:
            facts = facts.unionByName(reviewed.select(*names))
        self._go("r1_snapshot_frozen", facts=self._frozen(facts, "facts"))

    def compute(self) -> dict[str, str]:
        """A round: each report from the frozen input and facts in one pass, its digest kept as evidence."""
        self._in("r1_snapshot_frozen", "r1_computed")
        n = 1 if self.state == "r1_snapshot_frozen" else 2
        if n == 2 and self._said("round2") is not None:
            raise SessionError("round 2 is computed once")
        r, facts = self.relations, self._table("facts")
        if n == 2:
            gates.assert_empty(replay.missing_facts(r.videos, facts), "round 2 has every fact")
        mapped = C.mapped_videos(r.videos, N.final_mappings(N.resolve(r.videos, r.names, facts=facts)))
        gates.assert_empty(C.missing_records(mapped, r.channels), "every channel has a record", ForeignKeyViolation)
        eligible = C.eligible_videos(mapped, C.verdicts(mapped, r.channels, r.names))
        runs = r.runs.where(F.col("run_id").isin(list(self.reports.values())))
        per_artist = self.spark.read.parquet(self._frozen(exact.artists(eligible, r.runs), f"artists-round{n}"))
        told = {x.run_id: x.digest for x in exact.canonical_reports(runs, per_artist, exact.scores(per_artist), r.artists).collect()}  # the two bound reports
        out = {report: told[run] for report, run in sorted(self.reports.items())}
        self._go("r1_computed", **{f"round{n}": out})
        return out

    def verdict(self, snapshot_hash: str = "") -> list[str]:
        """What keeps the session from passing; it has passed if the list is empty, and failed otherwise."""
        self._in("r1_computed")
        digests = self.digests
        if not any(d[1] == 2 for d in digests):
            raise SessionError("no verdict before round 2")
        spark, sid = self.spark, self.session_id
        sessions = spark.createDataFrame([(sid, COMPARISON_CONTRACT)], "session_id string, contract string")
        rounds = spark.createDataFrame([(sid, n, self.source_run_id, snapshot_hash, PIPELINE_VERSION, manifest_hash(self.engine_name)) for n in (1, 2)], "session_id string, round int, source_run_id string, snapshot_hash string, engine_version string, manifest_hash string")
        found = sorted(r.violation for r in replay.pass_gate(sessions, rounds, spark.createDataFrame(digests, DIGESTS)).collect())
        self._go("failed" if found else "passed", found=found)
        return found


