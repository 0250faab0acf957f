"""line locators in texts that nothing durable stands beside, found in expressions over whole texts.

A locator is a line number, after a colon or after the word for lines; several with only separators between them are a run. A
run of three or more is an enumeration. A shorter one is bare if within 240 characters there is no quotation, section, decision
or item. A colon's run needs a path before it on its line, as else it is a locator into nothing; a run inside a
quotation is only quoted. Matches are found by marking them in a line and cutting it at the marks, so a line's spans are
arrays of places, and what lies near a run is an overlap of intervals. No row leaves its task.

Defined results: a null or empty text has no findings; rows are handled each for itself. Places count characters from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What locators, paths, quotations and anchors look like, and how near an anchor must be.
WINDOW, QUOTED, ENUMERATION = 240, 12, 3
KIND_ENUMERATION, KIND_BARE, UNNAMED = "LOCATOR-ENUMERATION", "BARE-LOCATOR", "<file named outside this line>"
EXTENSIONS = ("md", "markdown", "ts", "tsx", "js", "mjs", "cjs", "py", "yml", "yaml", "sql", "json", "toml", "sh", "ps1", "txt")
#: A path begins where a run of its characters does: what fails there fails further on too, and isn't tried again.
PATH = rf"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_.@/-]*\.(?:{'|'.join(EXTENSIONS)})\b"
ITEM = r"\d{1,6}(?:\s*[-–—]\s*:?\d{1,6})?"
SEPARATOR = r"(?:\s*,\s*(?:and\s+|e\s+)?|\s+(?:and|e)\s+|\s*;\s*)"
#: A first letter is looked for before a word's begin is, which costs far more to tell in Unicode.
RUN = rf"(?=(?i:l))\b(?i:lin(?:es?|has?))\s+{ITEM}(?:{SEPARATOR}{ITEM})*+|:{ITEM}(?:{SEPARATOR}:{ITEM})*+"
QUOTATION = rf'"[^"]{{{QUOTED},}}"|“[^”]{{{QUOTED},}}”'
ANCHOR = r"§\s*\*{0,2}[^\s*]|(?=(?i:[dira]))\b(?:D\d{1,2}\b|(?i:(?:items?|itens?)\s+\*{0,2}#?\d|rows?\s+\*{0,2}\d|(?:Annex|Anexo)\s+[A-Z]\b))"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


SPANS = "array<struct<start:int,stop:int,match:string,k:int>>"


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order: an array of (start, stop, match), places from 0. The text must hold neither \\x01 nor \\x02."""
    cut = F.split(F.regexp_replace(text, f"(?U)(?:{pattern})", "\x01$0\x02"), "[\x01\x02]", -1)
    # What is used for each match is bound by a transform of one element, so that it is worked out once a text.
    stops = lambda c: F.aggregate(F.transform(c, F.length), F.array(F.lit(0)), lambda to, n: F.concat(to, F.array(F.element_at(to, -1) + n)))
    told = lambda c, to: F.transform(c, lambda x, k: F.struct(to[k].alias("start"), to[k + 1].alias("stop"), x.alias("match"), k.alias("k")))
    each = F.flatten(F.transform(F.array(cut), lambda c: F.flatten(F.transform(F.array(stops(c)), lambda to: told(c, to)))))
    return F.filter(each, lambda c: c["k"] % 2 == 1)


def lines(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with line_no and line in the place of the text. Explosions here are outer ones: for others the engine puts a filter
    on the array's size before them, which works the array out again."""
    plain = F.translate(column, "\x01\x02", "\x03\x03")
    return texts.select(*(c for c in texts.columns if c != column), F.posexplode_outer(F.split(plain, LINE_END, -1)).alias("line_no", "line")).where("line IS NOT NULL").withColumn("line_no", F.col("line_no") + 1)


def findings(texts: DataFrame, column: str = "text") -> DataFrame:
    """The other columns of texts with line_no, place, kind, cited_path and snippet of each finding."""
    kept = [c for c in texts.columns if c != column]
    found = lines(texts, column).where(F.col("line").rlike(f"(?U){RUN}")).withColumn("runs", spans(F.col("line"), RUN)).withColumn("paths", spans(F.col("line"), PATH)).withColumn("quotes", F.when(F.col("line").rlike('["“]'), spans(F.col("line"), QUOTATION)).otherwise(F.array().cast(SPANS)))

    def told(run: Column) -> Column:
        low, high = F.greatest(run["start"] - WINDOW, F.lit(0)), F.least(run["stop"] + WINDOW, F.length("line"))
        before = F.filter("paths", lambda p: p["stop"] <= run["start"])
        last = F.try_element_at(before, F.lit(-1))["match"]
        return F.struct(
            (run["start"] + 1).alias("place"), F.trim(run["match"]).alias("snippet"), run["match"].startswith(":").alias("colon"),
            last.alias("cited_path"),
            F.size(F.regexp_extract_all(run["match"], F.lit(f"(?U):?{ITEM}"), F.lit(0))).alias("items"),
            F.exists("quotes", lambda q: (q["start"] <= run["start"]) & (run["stop"] <= q["stop"])).alias("quoted"),
            (F.exists("quotes", lambda q: (q["start"] < high) & (q["stop"] > low)) | F.substring(F.col("line"), low + 1, high - low).rlike(f"(?U){ANCHOR}")).alias("durable"),
        )

    runs = found.select(*kept, "line_no", F.explode_outer(F.transform("runs", told)).alias("r")).where("r IS NOT NULL").select(*kept, "line_no", "r.*")
    kind = F.when(F.col("items") >= ENUMERATION, KIND_ENUMERATION).when(~F.col("durable"), KIND_BARE)
    into = F.col("cited_path").isNotNull() | ~F.col("colon")
    return runs.where(into & ~F.col("quoted")).withColumn("kind", kind).where("kind IS NOT NULL").select(*kept, "line_no", "place", "kind", F.coalesce("cited_path", F.lit(UNNAMED)).alias("cited_path"), "snippet")
