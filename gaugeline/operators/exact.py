"""The digest tier: 50-digit decimals, as strings, so that a report is the same byte for byte.

Spark has no such decimals, so they are worked out in Python, narrow rows only: figures() folds the sorted videos of each
artist, and scores() takes one short row an artist for each run. The evidence of artists that a report shows streams into its
digest. Nothing but the shown rows reaches the driver."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, date, datetime
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal, localcontext
from itertools import chain, groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gaugeline.errors import FutureVideo, refuse
from gaugeline.plans.config import PIPELINE_VERSION, RESOLVER_VERSION, FilterRule, ReportRules, Rubric, canonical_json

# The keys and texts of the evidence and the report are part of the golden digest.
ZERO, ONE = Decimal(0), Decimal(1)
ARTIST = "run_id string, artist_id string, signals int, competition int, velocity string, engagement string, recent int, prior int, reason string, example string"
SCORE = "run_id string, artist_id string, norm_velocity string, norm_signals string, norm_engagement string, norm_diversity string, final_score int, rank int"


def frame(rubric: Rubric) -> Context:
    return Context(prec=rubric.precision, rounding=ROUND_HALF_EVEN)


def middle(values: Iterable[Decimal]) -> Decimal:
    v = sorted(values)
    low, high = v[(len(v) - 1) // 2], v[len(v) // 2]
    return low if len(v) % 2 else (low + high) / Decimal(2)


def at_share(values: Iterable[Decimal], share: Decimal) -> Decimal:
    """The inclusive percentile with linear interpolation."""
    v = sorted(values)
    place = Decimal(len(v) - 1) * share
    low = int(place)
    return v[low] if low + 1 >= len(v) else v[low] + (place - Decimal(low)) * (v[low + 1] - v[low])


def text(value: Decimal | None) -> str | None:
    return None if value is None else str(value)


def number(value: object) -> int | None:
    return None if value is None or value is pd.NA or value != value else int(value)  # noqa: PLR0124


class Fold:
    """The figures of an artist, whose eligible videos come by add() in the order of their ids.

    Sums are decimals, added up in that order. Of what the median is taken from, 16 bytes a video are held."""

    def __init__(self, rubric: Rubric, rules: ReportRules, weights: dict[int, Decimal]):
        self.rubric, self.weights, self.day = rubric, weights, 86_400_000_000 * rules.growth_days
        self.halving = Decimal("0.5").ln()
        self.views, self.ages, self.channels, self.last = array("q"), array("q"), set(), None
        self.signals = self.recent = self.prior = 0
        self.weighted = self.weight = ZERO

    def add(self, video_id: str, channel_id: str | None, views: int | None, likes: int | None, comments: int | None, age: int) -> None:
        self.signals += video_id != self.last
        self.last = video_id
        if channel_id is not None:
            self.channels.add(channel_id)
        if age < self.day:
            self.recent += 1
        elif age < 2 * self.day:
            self.prior += 1
        if views is None:
            return
        self.views.append(views)
        self.ages.append(age)
        if views:
            if (weight := self.weights.get(age)) is None:
                if len(self.weights) >= MEMO:
                    self.weights.clear()
                weight = self.weights[age] = (self.halving * days(age, self.rubric) / self.rubric.half_life_days).exp()
            self.weight += weight
            self.weighted += weight * (Decimal((likes or 0) + (comments or 0)) / Decimal(views))

    def done(self) -> dict:
        velocity = median_velocity(np.frombuffer(self.views, np.int64), np.frombuffer(self.ages, np.int64), self.rubric) if self.views else None
        engagement = self.weighted / self.weight if self.weight else None
        return {"signals": self.signals, "competition": len(self.channels), "velocity": text(velocity), "engagement": text(engagement), "recent": self.recent, "prior": self.prior}


#: So many weights by age are kept; doubles that differ by more than this share stand in the order of the decimals that they were made from.
MEMO, APART = 65_536, 1e-12


def days(age: int, rubric: Rubric) -> Decimal:
    return max(Decimal(age) / Decimal(1_000_000) / Decimal(86400), rubric.age_floor_days)


def median_velocity(views: np.ndarray, ages: np.ndarray, rubric: Rubric) -> Decimal:
    """The median of views by age. Doubles say which videos stand in the middle; only those are worked out in decimals."""
    rough = views / np.maximum(ages / 86_400e6, float(rubric.age_floor_days))
    places = sorted({(len(rough) - 1) // 2, len(rough) // 2})
    at = np.partition(rough, places)[places]
    low, high = at[0] - abs(at[0]) * APART, at[-1] + abs(at[-1]) * APART
    before, near = int((rough < low).sum()), (rough >= low) & (rough <= high)
    pairs, counts = np.unique(np.stack([views[near], ages[near]]), axis=1, return_counts=True)
    found = sorted((Decimal(v) / days(a, rubric), n) for v, a, n in zip(*pairs.tolist(), counts.tolist(), strict=True))
    chosen, seen = [], before
    for value, n in found:
        chosen += [value for place in places if seen <= place < seen + n]
        seen += n
    return middle(chosen)


def one_artist(videos: pd.DataFrame, rubric: Rubric, rules: ReportRules) -> dict:
    """Velocity, engagement, growth counts, and the example with its reasons, of an artist's eligible videos."""
    ordered = videos.sort_values("video_id")
    rows = [(v.video_id, number(v.views), int(v.at_micros), int(v.age_micros)) for v in ordered.itertuples()]
    with localcontext(frame(rubric)):
        fold = Fold(rubric, rules, {})
        for v, (video_id, views, _, age) in zip(ordered.itertuples(), rows, strict=True):
            fold.add(video_id, v.channel_id, views, number(v.likes), number(v.comments), age)
        told = fold.done()
        fast = by_velocity(rows, rubric)
    reason = {"candidates": [candidate(r) for r in fast], **said_of(fast[:3])}
    return {**told, "reason": json.dumps(reason), "example": reason["selected_example"]["video_id"]}


def by_velocity(rows: list[tuple], rubric: Rubric) -> list[dict]:
    """Rows (video_id, views, at_micros, age_micros) as the evidence has them, the fastest first, then by id; those without views last."""
    rows = [{"id": i, "views": views, "at": at, "vel": None if views is None else Decimal(views) / days(age, rubric)} for i, views, at, age in rows]
    return sorted(rows, key=lambda r: (r["vel"] is None, -(r["vel"] or ZERO), r["id"]))


def iso(r: dict) -> str:
    return datetime.fromtimestamp(r["at"] // 1_000_000, UTC).replace(microsecond=r["at"] % 1_000_000).isoformat()


def candidate(r: dict) -> dict:
    return {"video_id": r["id"], "views": r["views"], "published_at": iso(r), "vel": text(r["vel"])}


def said_of(three: list[dict]) -> dict:
    """The evidence beside the candidates, of the fastest three: which is the example, and why."""
    key = lambda r: (-r["at"], -(r["views"] if r["views"] is not None else -1))
    best = sorted(three, key=lambda r: (*key(r), r["id"]))
    chosen, second = best[0], best[1] if len(best) > 1 else None
    applied = "primary" if second is None or chosen["at"] != second["at"] else "secondary" if key(chosen) != key(second) else "final"
    return {
        "top3": [{"video_id": r["id"], "vel": text(r["vel"]), "rank": n} for n, r in enumerate(three, 1)],
        "tiebreak": {"order_by": "vel_desc, video_id_asc", "primary": "most_recent_published_at", "secondary": "max_views_absolute", "final": "min_video_id", "applied": applied},
        "selected_example": {"video_id": chosen["id"], "published_at": iso(chosen), "views": chosen["views"], "vel": text(chosen["vel"])},
    }


def timed(eligible: DataFrame, runs: DataFrame) -> DataFrame:
    """What the tier reads of eligible videos, with the ages that they have at their window's end."""
    end, at = F.unix_micros("window_end"), F.unix_micros("published_at")
    age = F.when(at > end, refuse(FutureVideo, "published after the window's end").cast("long")).otherwise(end - at)
    return eligible.join(runs.select("run_id", "window_end"), "run_id").select("run_id", "artist_id", "video_id", "channel_id", "views", "likes", "comments", at.alias("at_micros"), age.alias("age_micros"))


def artists(eligible: DataFrame, runs: DataFrame, rubric: Rubric | None = None, rules: ReportRules | None = None) -> DataFrame:
    """One row for each artist of a run, numbers as strings, with the whole evidence: an artist's videos meet in one frame.
    figures() has no evidence and holds no artist."""
    rubric, rules = rubric or Rubric(), rules or ReportRules()
    # Counts go as strings: pandas would make floats of longs with nulls.
    narrow = timed(eligible, runs).withColumns({c: F.col(c).cast("string") for c in ("views", "likes", "comments")})

    def run(key: tuple, videos: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"run_id": key[0], "artist_id": key[1], **one_artist(videos, rubric, rules)}])

    return narrow.groupBy("run_id", "artist_id").applyInPandas(run, ARTIST)


FIGURES = "run_id string, artist_id string, signals int, competition int, velocity string, engagement string, recent int, prior int"


def by_artist(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(run_id, artist_id) and its further columns, row by row, of rows that come sorted by them."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return ((key, (r[2:] for r in group)) for key, group in groupby(rows, key=lambda r: r[:2]))


def batch_of(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(target)], schema=target)


def figures(videos: DataFrame, rubric: Rubric | None = None, rules: ReportRules | None = None) -> DataFrame:
    """What artists() says but for the evidence, of timed() videos: they stream by artist in the order of their ids."""
    rubric, rules = rubric or Rubric(), rules or ReportRules()
    narrow = videos.select("run_id", "artist_id", "video_id", "channel_id", "views", "likes", "comments", "age_micros")
    target = to_arrow_schema(StructType.fromDDL(FIGURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[int, Decimal] = {}
        for key, rows in by_artist(batches):
            with localcontext(frame(rubric)):
                fold = Fold(rubric, rules, weights)
                for row in rows:
                    fold.add(*row)
                told = (*key, *fold.done().values())
            yield batch_of([told], target)

    return narrow.repartition("run_id", "artist_id").sortWithinPartitions("run_id", "artist_id", "video_id").mapInArrow(run, FIGURES)


PARTS = "run_id string, artist_id string, part int, example string, said string, body string"


def evidence(videos: DataFrame, rubric: Rubric | None = None, size: int = 1000) -> DataFrame:
    """The evidence of each artist of timed() videos in parts: the first and the last have the example and what is said beside
    the candidates, those between up to about ``size`` candidates each as canonical JSON, the fastest first.

    Videos come sorted by their velocity in doubles; only those nearer to one another than doubles tell are held and sorted by decimals."""
    rubric = rubric or Rubric()
    rough = F.col("views") / F.greatest(F.col("age_micros") / 86_400e6, F.lit(float(rubric.age_floor_days)))
    narrow = videos.select("run_id", "artist_id", rough.alias("rough"), "video_id", "views", "at_micros", "age_micros")
    target = to_arrow_schema(StructType.fromDDL(PARTS))

    def ordered(rows: Iterable[tuple]) -> Iterator[dict]:
        held, last = [], None
        for rough, *row in rows:
            if held and rough is not None and last - rough > APART * max(abs(last), abs(rough)) or (held and rough is None and last is not None):
                yield from by_velocity(held, rubric)
                held = []
            if rough is None:  # these come last, by id
                yield from by_velocity([tuple(row)], rubric)
            else:
                held.append(tuple(row))
            last = rough
        yield from by_velocity(held, rubric)

    def parts(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        fast = ordered(rows)
        three = list(islice(fast, 3))
        told = said_of(three)
        ends, n, some = (told["selected_example"]["video_id"], canonical_json(told)), 0, []
        yield (*key, 0, *ends, None)
        for r in chain(three, fast):
            some.append(canonical_json(candidate(r)))
            if len(some) == size:
                n += 1
                yield (*key, n, None, None, ("," if n > 1 else "") + ",".join(some))
                some = []
        if some:
            n += 1
            yield (*key, n, None, None, ("," if n > 1 else "") + ",".join(some))
        yield (*key, n + 1, *ends, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with localcontext(frame(rubric)):
            for key, rows in by_artist(batches):
                for part in parts(key, rows):
                    yield batch_of([part], target)

    order = ("run_id", "artist_id", F.desc_nulls_last("rough"), "video_id")
    return narrow.repartition("run_id", "artist_id").sortWithinPartitions(*order).mapInArrow(run, PARTS)


def score_run(rows: pd.DataFrame, rubric: Rubric) -> pd.DataFrame:
    """Components, score and rank of a run's artists."""
    out = []
    with localcontext(frame(rubric)):
        speed = {r.artist_id: Decimal(r.velocity) if r.velocity is not None else None for r in rows.itertuples()}
        engaged = {r.artist_id: Decimal(r.engagement) if r.engagement is not None else None for r in rows.itertuples()}

        def part(values: dict[str, Decimal | None], share: Decimal) -> dict[str, Decimal]:
            known = [v for v in values.values() if v is not None]
            anchor = at_share(known, share) if known else ZERO
            return {k: min(v / anchor, ONE) if v is not None and anchor > 0 else ZERO for k, v in values.items()}

        def full(n: int, cap: int) -> Decimal:
            return min(Decimal(1 + n).ln() / Decimal(1 + cap).ln(), ONE)

        fast, keen = part(speed, rubric.velocity_percentile), part(engaged, rubric.engagement_percentile)
        for r in rows.itertuples():
            signals, diversity = full(r.signals, rubric.signals_cap), full(r.competition, rubric.diversity_target)
            raw = Decimal(100) * (rubric.velocity * fast[r.artist_id] + rubric.signals * signals + rubric.engagement * keen[r.artist_id] + rubric.diversity * diversity)
            out.append((r.run_id, r.artist_id, fast[r.artist_id], signals, keen[r.artist_id], diversity, int(raw.quantize(ONE, rounding=ROUND_HALF_UP))))
    out.sort(key=lambda s: (-s[6], -s[2], -s[3], s[1]))
    return pd.DataFrame([(*s[:2], *map(str, s[2:6]), s[6], n) for n, s in enumerate(out, 1)], columns=[c.split()[0] for c in SCORE.split(", ")])


def scores(per_artist: DataFrame, rubric: Rubric | None = None) -> DataFrame:
    rubric = rubric or Rubric()
    narrow = per_artist.select("run_id", "artist_id", "signals", "competition", "velocity", "engagement")
    return narrow.groupBy("run_id").applyInPandas(lambda rows: score_run(rows, rubric), SCORE)


def shown_velocity(value: Decimal | None, rubric: Rubric) -> str | None:
    if value is None:
        return None
    with localcontext(frame(rubric)):
        if value >= 1000:
            return f"{(value / Decimal(1000)).quantize(Decimal('0.1'), rounding=ROUND_HALF_UP)}k/day"
        return f"{value.quantize(ONE, rounding=ROUND_HALF_UP)}/day"


def versions_of(rule: FilterRule, rubric: Rubric, rules: ReportRules) -> dict[str, str]:
    return {"resolver_version": RESOLVER_VERSION, "rule_version": rule.version, "rule_hash": rule.hash, "rubric_version": rubric.version, "rubric_hash": rubric.hash, "opportunity_version": rules.version, "opportunity_hash": rules.hash}


def report_row(r: dict, versions: dict[str, str], rubric: Rubric, rules: ReportRules) -> dict:
    """A shown artist as the report has it. r: the columns of ARTIST and SCORE, and canonical_name."""
    level = "Low" if r["competition"] <= rules.low_channels else "Medium" if r["competition"] <= rules.high_channels else "High"
    with localcontext(frame(rubric)):
        growth = Decimal(r["recent"] - r["prior"]) / Decimal(r["prior"]) if r["prior"] else None
    fired = growth is not None and growth > rules.growth_above
    competition = {"count": r["competition"], "base_level": level, "level": "High" if fired else level, "recent_7d": r["recent"], "prior_7d": r["prior"], "growth_7d": text(growth), "growth_triggered": fired, "prior_zero_rule": "no-trigger"}
    made = {k: versions[k] for k in ("opportunity_version", "opportunity_hash", "rubric_version", "rubric_hash")}
    return {
        "run_id": r["run_id"], "rank": r["rank"], "artist_id": r["artist_id"], "title": f"{r['canonical_name']} Type Beat", "tag": "HOT" if r["final_score"] > rules.hot_above and r["rank"] <= rules.hot_most else None,
        "score_display": f"{r['final_score']}/100", "score_value": r["final_score"], "signals": r["signals"], "velocity_display": shown_velocity(Decimal(r["velocity"]) if r["velocity"] is not None else None, rubric),
        "competition_level": competition["level"], "competition_channel_count": r["competition"], "example_video_id": r["example"], "example_url": f"https://www.youtube.com/watch?v={r['example']}",
        "selection_reason_json": {**json.loads(r["reason"]), "versions": made, "competition": competition}, **versions,
    }


def report_body(run_id: str, window_end: datetime, versions: dict[str, str], rows: list[dict], *, insufficient: bool) -> dict:
    return {"run_id": run_id, "window_end": window_end.isoformat(), "pipeline_version": PIPELINE_VERSION, "insufficient_opportunity": insufficient, "provenance": versions, "rows": rows}


def shown_artists(per_artist: DataFrame, scored: DataFrame, names: DataFrame, rules: ReportRules) -> DataFrame:
    """The artists that reports show, at most a few a run, with all that is said of them. Ranks follow the score, so the gate keeps the first ones."""
    top = scored.where((F.col("final_score") >= rules.shown_from) & (F.col("rank") <= rules.items_most)).select("run_id", "artist_id", "final_score", "rank")
    return top.join(per_artist, ["run_id", "artist_id"]).join(names.select("artist_id", "canonical_name"), "artist_id")


def canonical_report(run_id: str, window_end: datetime, per_artist: DataFrame, scored: DataFrame, names: DataFrame, *, rule: FilterRule | None = None, rubric: Rubric | None = None, rules: ReportRules | None = None) -> dict:
    """One run's report with all that made it; at most the shown rows are collected. canonical_reports() is for many."""
    rule, rubric, rules = rule or FilterRule(), rubric or Rubric(), rules or ReportRules()
    versions = versions_of(rule, rubric, rules)
    shown = shown_artists(per_artist, scored, names, rules).where(F.col("run_id") == run_id).orderBy("rank").collect()
    rows = [report_row(r.asDict(), versions, rubric, rules) for r in shown]
    return report_body(run_id, window_end, versions, rows, insufficient=not rows)


def report_digest(report: dict) -> str:
    """F20, F21."""
    return hashlib.sha256(canonical_json(report).encode("utf-8")).hexdigest()


def plain(value: object) -> object:
    """A value as canonical JSON has it: numbers with many digits and times are texts."""
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def hashed(rows: DataFrame, key: list[str], frame_of: Callable[[dict], tuple[str, str]], row_of: Callable[[dict], dict | str | tuple[str, bool] | None], *, plain_text: bool = False) -> DataFrame:
    """F20, F21 on the executors: for each key n (rows), bytes and digest of a canonical JSON text that is never whole.

    rows come sorted, a key's together. frame_of gives what stands before and after the rows of a key, from its first one;
    row_of gives a row's object, or None for a row that only says that its key is there; with plain_text it gives the text itself.
    Where a row has only a part of an object, row_of gives that part's text and whether it begins the object. One row is held at a time."""
    schema = StructType([*rows.select(*key).schema.fields, StructField("n", LongType()), StructField("bytes", LongType()), StructField("digest", StringType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after, n, size, digest = None, "", 0, 0, hashlib.sha256()

        def put(part: str) -> None:
            nonlocal size
            coded = part.encode()
            size += len(coded)
            digest.update(coded)

        def done() -> list[tuple]:
            if now is None:
                return []
            put(after)
            return [(*now, n, size, digest.hexdigest())]

        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                at = tuple(row[c] for c in key)
                if at != now:
                    found += done()
                    now, n, size, digest = at, 0, 0, hashlib.sha256()
                    before, after = frame_of(row)
                    put(before)
                if isinstance(body := row_of(row), tuple):
                    put(("," if n and body[1] else "") + body[0])
                    n += body[1]
                elif body is not None:
                    put(("," if n else "") + (str(body) if plain_text else canonical_json(plain(body))))
                    n += 1
            yield batch_of(found, target)
        yield batch_of(done(), target)

    return rows.mapInArrow(run, schema)


def canonical_digests(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each key the number of its rows, and the bytes and digest of the canonical JSON list of them in order."""
    return hashed(rows.repartition(*key).sortWithinPartitions(*key, *order), key, lambda _: ("[", "]"), lambda row: row)


def canonical_reports(runs: DataFrame, per_artist: DataFrame, scored: DataFrame, names: DataFrame, *, videos: DataFrame | None = None, rule: FilterRule | None = None, rubric: Rubric | None = None, rules: ReportRules | None = None) -> DataFrame:
    """S11 of all runs in one pass: run_id, n (rows shown), bytes and digest of each run's canonical report, as canonical_report()
    and report_digest() give them. A run that shows nothing has a report too.

    With timed() ``videos``, per_artist is what figures() gives: only the shown artists' evidence is made, and it streams in parts.
    Without them per_artist is what artists() gives, and the evidence of one shown artist is the most that a task holds."""
    rule, rubric, rules = rule or FilterRule(), rubric or Rubric(), rules or ReportRules()
    versions = versions_of(rule, rubric, rules)
    ends = runs.select("run_id", F.unix_micros("window_end").alias("end_micros"))
    shown = shown_artists(per_artist, scored, names, rules)
    if videos is not None:
        shown = shown.join(evidence(videos.join(F.broadcast(shown.select("run_id", "artist_id")), ["run_id", "artist_id"], "left_semi"), rubric), ["run_id", "artist_id"])
    rows = ends.join(shown, "run_id", "left")

    def part_of(r: dict) -> tuple[str, bool] | None:
        """What the report's text has of a part of a row: all before its candidates, some of them, or all after them."""
        if r["rank"] is None:
            return None
        if r["body"] is not None:
            return r["body"], False
        mark = '"selection_reason_json":{"candidates":['
        whole = canonical_json(report_row({**r, "reason": '{"candidates": [], ' + r["said"][1:]}, versions, rubric, rules))
        before, mark, after = whole.partition(mark)
        return (before + mark, True) if r["part"] == 0 else (after, False)

    def frame_of(r: dict) -> tuple[str, str]:
        end = datetime.fromtimestamp(r["end_micros"] // 1_000_000, UTC).replace(microsecond=r["end_micros"] % 1_000_000)
        whole = canonical_json(report_body(r["run_id"], end, versions, [], insufficient=r["rank"] is None))
        before, mark, after = whole.partition('"rows":[]')
        return before + mark[:-1], "]" + after

    if videos is not None:
        return hashed(rows.repartition("run_id").sortWithinPartitions("run_id", "rank", "part"), ["run_id"], frame_of, part_of)
    return hashed(rows.repartition("run_id").sortWithinPartitions("run_id", "rank"), ["run_id"], frame_of, lambda r: None if r["rank"] is None else report_row(r, versions, rubric, rules))
