"""Data-quality gates: each gives the rows that break its rule, and a run goes on only if there are none."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType

from gaugeline.errors import CheckViolation, ForeignKeyViolation, GateError


def assert_empty(violations: DataFrame, gate: str, error: type[GateError] = CheckViolation) -> None:
    """Fails closed with the gate's class of error, telling a few of the rows; only these reach the driver."""
    if rows := violations.limit(5).collect():
        raise error(gate, rows=[str(r.asDict()) for r in rows])


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that don't have exactly one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n <> 1")


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null among the columns."""
    return rows.where(" OR ".join(f"`{c}` IS NULL" for c in columns))


def blanks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null or blank among the columns."""
    return rows.where(" OR ".join(f"coalesce(trim(`{c}`), '') = ''" for c in columns))


def set_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    only = lambda x, y, side: x.join(y, [x[k].eqNullSafe(y[k]) for k in key], "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the child that the parent lacks; one call a foreign key. Null keys refer to nothing."""
    present = child.select(*key).where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).distinct()
    return present.join(parent.select(*key).distinct(), key, "left_anti")


@dataclass(frozen=True)
class ForeignKey:
    """The columns of a child table that must name a row of a parent table by the columns there."""

    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    refers_to: tuple[str, ...]


#: What JSON escapes in a text.
ESCAPED = r'["\\\x00-\x1f]'


def listed(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """The columns' values as a JSON list of texts. Only texts with something to escape are put through to_json()."""
    values = [F.col(c).cast("string") for c in columns]
    plain = F.concat(F.lit('["'), *[x for v in values for x in (v, F.lit('","'))][:-1], F.lit('"]'))
    texts = [F.col(c) for c in columns if not isinstance(rows.schema[c].dataType, (NumericType, DateType))]
    if not texts:
        return plain
    return F.when(reduce(Column.__or__, (t.cast("string").rlike(ESCAPED) for t in texts)), F.to_json(F.array(*values))).otherwise(plain)


def foreign_keys(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """J12 for all foreign keys together: foreign_key, orphan (its values as a JSON list of texts) and n, the child rows that have it.

    Each table is read once, whatever number of keys it takes part in: a row gives one value for each of them, equal ones are
    summed in their task, and all keys meet their parents in one anti join. A Bloom filter of the parents could only show that a
    value is missing, never that it is there, so on good data it would spare nothing. A key with a null refers to nothing."""

    def values(table: str, side: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
        whole = [F.when(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns)), F.struct(F.lit(name).alias("foreign_key"), listed(tables[table], columns).alias("orphan"))) for name, columns in side]
        return tables[table].select(F.explode(F.array(*whole)).alias("v")).where("v IS NOT NULL").select("v.*").groupBy("foreign_key", "orphan").agg(F.count("*").alias("n"))

    def all_of(sides: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
        by_table: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for table, name, columns in sides:
            by_table.setdefault(table, []).append((name, columns))
        return reduce(DataFrame.unionByName, (values(table, side) for table, side in by_table.items()))

    children = all_of([(k.child, k.name, k.columns) for k in keys])
    parents = all_of([(k.parent, k.name, k.refers_to) for k in keys])
    return children.join(parents.select("foreign_key", "orphan"), ["foreign_key", "orphan"], "left_anti")


def assert_foreign_keys(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> None:
    assert_empty(foreign_keys(tables, keys), "every key refers to a row", ForeignKeyViolation)


def unequal(rows: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """Rows in which a pair isn't the same, null being the same as null only."""
    bad = F.lit(False)
    for a, b in pairs:
        bad = bad | ~a.eqNullSafe(b)
    return rows.where(bad)


def future(videos: DataFrame) -> DataFrame:
    """G15."""
    return videos.where("published_at > window_end")


def run_identity(runs: DataFrame, days: int = 30) -> DataFrame:
    """G1: runs without keyword or vertical, or whose window isn't exactly so long."""
    return runs.where(f"coalesce(trim(keyword), '') = '' OR coalesce(trim(vertical), '') = '' OR NOT (window_end - window_start <=> INTERVAL '{days}' DAY)")


def unvisited_pages(pages: DataFrame, walk: DataFrame) -> DataFrame:
    """Pages that the walk along tokens doesn't reach, or reaches twice."""
    seen = walk.groupBy("run_id", "page_token").agg(F.count("*").alias("visits"))
    p = pages.select("run_id", "page_token")
    joined = p.join(seen, (p["run_id"] == seen["run_id"]) & p["page_token"].eqNullSafe(seen["page_token"]), "left")
    return joined.where(~F.col("visits").eqNullSafe(F.lit(1))).select(p["run_id"], p["page_token"])


def dangling_tokens(pages: DataFrame, collected: DataFrame, target: int = 500) -> DataFrame:
    """Tokens that lead to no page, in runs that didn't collect the target."""
    tokens = pages.where("next_token IS NOT NULL").select("run_id", F.col("next_token").alias("page_token"))
    loose = tokens.join(pages.where("page_token IS NOT NULL").select("run_id", "page_token"), ["run_id", "page_token"], "left_anti")
    full = collected.groupBy("run_id").agg(F.countDistinct("video_id").alias("n")).where(F.col("n") == target)
    return loose.join(full, "run_id", "left_anti")


def unfinished(runs: DataFrame, collected: DataFrame, most: int = 500) -> DataFrame:
    """Finalized counts that differ from the distinct videos, exceed the cap, or stand on a failed run."""
    n = collected.groupBy("run_id").agg(F.countDistinct("video_id").alias("n"))
    return runs.join(n, "run_id", "left").where((F.col("status") == "failed") | ~F.col("video_count").eqNullSafe(F.coalesce("n", F.lit(0))) | (F.col("video_count") > most)).select("run_id", "status", "video_count", F.coalesce("n", F.lit(0)).alias("n"))


def several_values(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Groups in which the columns have more than one combination."""
    return rows.groupBy(*group).agg(F.count_distinct(F.struct(*columns)).alias("n")).where("n > 1")


def bad_evidence(rows: DataFrame, column: str, need: dict[str, str]) -> DataFrame:
    """Rows whose JSON lacks a path or has another kind there. need: path to 'array' (not empty), 'object' or 'text' (not blank)."""
    bad = F.lit(False)
    for path, kind in need.items():
        value = F.get_json_object(column, f"$.{path}")
        held = {"array": F.coalesce(F.json_array_length(value) > 0, F.lit(False)), "object": F.coalesce(F.size(F.json_object_keys(value)) >= 0, F.lit(False)), "text": F.coalesce(F.trim(value) != "", F.lit(False))}[kind]
        bad = bad | ~held
    return rows.where(bad)


def bad_transitions(changes: DataFrame, allowed: list[tuple[str | None, str]]) -> DataFrame:
    """Changes (old, new) that aren't among the allowed ones; old is null for a new row."""
    good = F.lit(False)
    for old, new in allowed:
        good = good | (F.col("old").eqNullSafe(F.lit(old)) & (F.col("new") == new))
    return changes.where(~F.coalesce(good, F.lit(False)))


REPORT_STATES = [(None, "draft"), ("draft", "draft"), ("draft", "published"), ("published", "archived")]
# The states of a session, in order.
SESSION_STATES = ("session_open", "r1_awaiting_review", "r1_resolved", "r1_snapshot_frozen", "r1_computed", "passed")


def session_transitions() -> list[tuple[str | None, str]]:
    """C11: one step on, or to failed, from every state that isn't an end; nothing else, not even to the same state."""
    steps: list[tuple[str | None, str]] = [(None, SESSION_STATES[0]), *zip(SESSION_STATES, SESSION_STATES[1:], strict=False)]
    return steps + [(s, "failed") for s in SESSION_STATES[:-1]]


#: So many rows go to a task of handshake(), but for the rows of one key.
TASK_ROWS = 1 << 19


def handshake(left: DataFrame, right: DataFrame, key: list[str], column: str) -> DataFrame:
    """Groups whose rows of ``column`` differ between two stages, with how many only one of them has. Repeated rows count;
    rows with a null are like no others.

    Rows of both stages are counted against each other after one shuffle by key, to as many tasks as the rows need."""
    alone = reduce(Column.__or__, (F.col(c).isNull() for c in (*key, column)))
    one = lambda rows, n: rows.select(*key, column, F.when(alone, n).alias("__alone"), F.lit(n).cast("long").alias("__n"))
    both = one(left, 1).unionByName(one(right, -1))
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(max(least, (left.count() + right.count()) // TASK_ROWS + 1), *key)
    net = dealt.groupBy(*key, column, "__alone").agg(F.sum("__n").alias("__n"))
    return net.groupBy(*key).agg(F.sum(F.greatest("__n", F.lit(0))).alias("only_left"), F.sum(F.greatest(-F.col("__n"), F.lit(0))).alias("only_right")).where("only_left > 0 OR only_right > 0")


def unlike_body(rows: DataFrame, body: str, kind: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows that differ from the body they were projected from. columns: path and type of each column in the body;
    an absent path is null, and null is never 0. A body is parsed once, bound as an array of one, since a filter would else
    repeat the parse, and whatever makes the body, for each column. A body that isn't JSON has no kind."""

    def differs(parsed: Column) -> Column:
        at = lambda path: F.try_variant_get(parsed, f"$.{path}", "string")
        return reduce(Column.__or__, (~F.col(c).eqNullSafe(at(path).cast(to)) for c, (path, to) in columns.items()), ~at("kind").eqNullSafe(F.lit(kind)))

    return rows.where(F.exists(F.array(F.try_parse_json(body)), differs))


def is_admin(users: DataFrame, admins: DataFrame) -> DataFrame:
    """Users (user_id) who are admins whose right isn't revoked."""
    return users.join(admins.where("revoked_at IS NULL").select("user_id"), "user_id", "left_semi")


def locked_by_reports(changed: DataFrame, items: DataFrame, reports: DataFrame, key: list[str]) -> DataFrame:
    """Changed rows that an item of a published or archived report refers to."""
    fixed = items.join(reports.where("status IN ('published', 'archived')").select("report_id"), "report_id", "left_semi")
    return changed.join(fixed.select(*key), key, "left_semi")
