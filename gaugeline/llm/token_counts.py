"""Token counts: a two-tier map-side lookup in front of the tokenizer's library.

The vocabulary is a SentencePiece BPE model none of whose pieces goes on over the end of a word or over a
line break, and which takes texts as they are, so a text's count is the sum over its pre-tokens: a word with
the spaces before it, a line break, or what follows one. Both are checked when a model is loaded. The first tier
is a broadcast table of the lengths of the pre-tokens that are frequent in a sample of some ``SAMPLE_ROWS``
documents, which bounds it; the second is a cache in each Python worker, which asks the library for what it
doesn't hold and keeps it for all tasks of a count that the worker gets. What is in either makes no difference to the counts. No pre-token is shuffled, and every text is
read by Python once.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens. Special strings inside a
text are ordinary text, the library's default. Rows with one id are counted each for itself; a null
doc_id is carried. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import map_columns, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: The runs of a text that are counted each for itself: a line break, a word with the spaces before it, other spaces.
RUNS = re.compile(r"\n| *[^ \n]+| +")
#: Characters that the keys or the model itself use; texts that hold one go to the library whole.
OWN = re.compile("[\0\u2581]")
SAMPLE_ROWS = 4096
LONGEST = 48  # longer pre-tokens are not kept in tables


def pre_tokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens. The library puts a space before the text, so most have one before them:
    "x" stands for a space and x, a line break for itself and what follows it, NUL for one space alone,
    and NUL and x for x alone."""
    marked = text.replace("\n", " \n")
    if "  " not in marked and marked[:1] != " " and marked[-1:] != " ":
        return marked.split(" ") if text else []
    keys = []
    for run in RUNS.findall(f" {text}"):
        if run == "\n":
            keys.append(run)
        elif run[0] != " ":
            keys.append(f"\0{run}")
        else:
            keys.append(run[1:] or "\0")
    return keys


class Lengths(dict):
    """Token counts of pre-tokens; what is missing is encoded, and kept while there is room."""

    def __init__(self, model_path: str, known: dict[str, int], room: int, check: bool = False):
        import sentencepiece

        super().__init__(known)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if check and not splits(self.library):
            raise ValueError(f"{model_path} has pieces that cross the ends of words, or changes characters")
        self.room = room + len(known)

    def __missing__(self, token: str) -> int:
        n = self.count(token)
        if len(token) <= LONGEST and len(self) < self.room:
            self[token] = n
        return n

    def count(self, token: str) -> int:
        if token == "\0":
            return 1  # a single space
        if token[:1] == "\0":  # follows a line break, with no space before it
            return len(self.library.encode(f"\n{token[1:]}")) - 2
        if token[:1] == "\n":
            return len(self.library.encode(token)) - 1
        return len(self.library.encode(token))

    def total(self, text: str | None) -> int:
        if not text:
            return 0
        if OWN.search(text):
            return len(self.library.encode(text))
        return sum(map(self.__getitem__, pre_tokens(text)))


_HELD: dict[str, Lengths] = {}


def worker_lengths(name: str, model_path: str, known: dict[str, int], room: int) -> Lengths:
    """The Lengths of a count by its name: one for each Python worker, made by its first task and kept for the next ones.

    A worker keeps that of one count only."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Lengths(model_path, known, room)
    return _HELD[name]


def splits(library) -> bool:  # noqa: ANN001
    """Whether counting by pre-tokens is right for a model: no piece crosses a word's end or a line break, and no character is changed."""
    pieces = [library.id_to_piece(i) for i in range(library.vocab_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
    whole = all("\u2581" not in p.lstrip("\u2581") and ("\n" not in p or p == "\n") for p in pieces)
    some = "".join(chr(c) for c in [*range(0x20, 0xD800), *range(0xE000, 0x10000), 0x1F642] if c != 0x2581)
    return whole and library.normalize(f"a  {some}\n b ") == f"\u2581a  {some}\n b ".replace(" ", "\u2581")


def frequent(docs: DataFrame, *, size: int = 32_768, sample_rows: int = SAMPLE_ROWS, per_task: int = 8_192) -> list[str]:
    """The ``size`` pre-tokens counted most often in a random sample of some ``sample_rows`` documents. Tasks hand out the
    ``per_task`` leaders of what they saw of it, so what reaches the driver is bounded by the sample."""
    texts = docs.select("text")
    share = min(1.0, sample_rows / max(texts.count(), 1))

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        seen: Counter[str] = Counter()
        for (some,) in batches:
            for text in some:
                if text and not OWN.search(text):
                    seen.update(pre_tokens(text))
                    if len(seen) > 16 * per_task:
                        seen = Counter(dict(seen.most_common(2 * per_task)))
        top = [x for x in seen.most_common(per_task) if len(x[0]) <= LONGEST and x[1] > 1]
        if top:
            yield list(map(list, zip(*top, strict=True)))

    total: Counter[str] = Counter()
    for row in map_columns(texts.sample(share, seed=1), run, "token string, n long").collect():
        total[row["token"]] += row["n"]
    return [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def count_tokens(docs: DataFrame, *, model: str = MODEL, limit: int = 4096, table_size: int = 32_768, cache_size: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each document's whole text."""
    spark = docs.sparkSession
    tokens = frequent(docs, size=table_size)
    library = Lengths(tokenizer_path(model), {}, 0, check=True)
    table, name = spark.sparkContext.broadcast({t: library.count(t) for t in tokens}), uuid.uuid4().hex

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        lengths = worker_lengths(name, tokenizer_path(model), table.value, cache_size)
        for ids, texts in batches:
            yield [ids, [len((t or "").encode("utf-8", "replace")) for t in texts], n := list(map(lengths.total, texts)), [x > limit for x in n]]

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
