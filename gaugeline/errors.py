"""Refusals by name (R9): a class for each, raised on the driver or in a plan, and mapped back to its class.

In a plan a refusal is ``raise_error`` with the class's name and its parameters as JSON. Spark hands that out as an error
of its own, somewhere in the message of a failed job; ``typed_errors()`` around an action turns it into the class again.
Python code in a task that raises one of the classes is found by the same mark."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F


class GaugelineError(RuntimeError):
    """What the engine refuses. ``parameters`` say what it was about."""

    def __init__(self, message: str = "", **parameters: object):
        self.message, self.parameters = message, parameters
        super().__init__(f"[GAUGELINE.{type(self).__name__}] {json.dumps({'message': message, **parameters}, default=str, ensure_ascii=False)}")


class BodyError(GaugelineError):
    """A landed body can't be projected."""


class MalformedBody(BodyError):
    """The text isn't one JSON value and nothing else."""


class WrongKind(BodyError):
    """The body is of another kind."""


class TransportKeys(BodyError):
    """The body carries keys of its transport."""


class TextExpected(BodyError):
    """A text of the body is something else."""


class FieldMissing(BodyError):
    """A field that must be there is null or blank."""


class CountExpected(BodyError):
    """A counter isn't a whole number."""


class PaginationError(GaugelineError):
    """A run's pages can't be walked to a stop."""


class RepeatedToken(PaginationError):
    """A token leads to a page that was walked already."""


class PageCeiling(PaginationError):
    """As many pages as are allowed, and no stop."""


class BlankToken(PaginationError):
    """The next token is there and empty."""


class MissingPage(PaginationError):
    """A token leads to no landed page."""


class OutsideTitle(GaugelineError):
    """A pending candidate isn't in its title, or a title wasn't judged."""


class FutureVideo(GaugelineError):
    """A video was published after its window's end."""


class GateError(GaugelineError):
    """A gate found rows that break its rule."""


class NotNullViolation(GateError):
    """A value that must be there is null or blank."""


class ForeignKeyViolation(GateError):
    """A key refers to nothing."""


class UniqueViolation(GateError):
    """A key that must be unique isn't."""


class CheckViolation(GateError):
    """A rule on a row's or group's values is broken."""


class IntegrityViolation(GateError):
    """Something final or append-only would be changed, or a step taken that isn't allowed."""


class RunExists(UniqueViolation):
    """A run is written or claimed already."""


class RunMissing(GaugelineError):
    """A run isn't published."""


class SessionError(GaugelineError):
    """A step that a session's state doesn't allow, or that breaks a rule."""


class SessionConflict(SessionError):
    """Another writer appended to the session's log first."""


def classes(of: type[GaugelineError] = GaugelineError) -> dict[str, type[GaugelineError]]:
    found = {of.__name__: of}
    for below in of.__subclasses__():
        found |= classes(below)
    return found


def refuse(error: type[GaugelineError], message: str, **parameters: Column | str) -> Column:
    """A column that raises the error when it is evaluated; it is a null text by its type."""
    told = [F.lit(message).alias("message"), *((v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in parameters.items())]
    return F.raise_error(F.concat(F.lit(f"[GAUGELINE.{error.__name__}] "), F.to_json(F.struct(*told)))).cast("string")


#: Spark's own conditions that are refusals of the engine.
CONDITIONS: dict[str, type[GaugelineError]] = {"PATH_ALREADY_EXISTS": IntegrityViolation}
MARK = re.compile(r"\[GAUGELINE\.(\w+)\] (?=\{)")


def typed(error: BaseException) -> BaseException:
    """The refusal that an error of Spark stands for, or the error itself."""
    if not isinstance(error, GaugelineError):
        for found in MARK.finditer(str(error)):
            if of := classes().get(found[1]):
                try:
                    parameters, _ = json.JSONDecoder(strict=False).raw_decode(str(error), found.end())
                except ValueError:
                    parameters = {}
                return of(str(parameters.pop("message", "")), **parameters)
        if isinstance(error, PySparkException) and (of := CONDITIONS.get(error.getCondition() or "")):
            return of(str(error).partition("\n")[0])
    return error


@contextmanager
def typed_errors() -> Iterator[None]:
    """Actions inside raise the engine's own errors for its own refusals."""
    try:
        yield
    except PySparkException as error:
        found = typed(error)
        if found is error:
            raise
        raise found from error
