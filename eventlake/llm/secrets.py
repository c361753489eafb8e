"""Secret scan with an incremental blob ledger.

Every historical version of a path is content-addressed: a blob is the SHA-256 of its text. The ledger is a folder of
rows (blob, rules, spans): which rule versions a blob was scanned with, and what they found. A scan takes only blobs and
rule versions that the ledger has not seen, one text per blob, appends its rows, and joins the findings of all blobs back
to all paths. Equal texts meet in a map-side combined aggregate, so a blob with millions of paths is no hot group.

Defined results: a null text is the empty blob; paths may repeat and be null; a path without findings has an empty list.
Rules are kept apart by version: raising one scans all blobs again with it alone, and its older findings are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, a test of its matches, and words of which a lower-cased text must hold one to be worth scanning."""

    name: str
    version: int
    pattern: str
    check: Callable[[re.Match], bool] | None = None
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}"


def _long_value(m: re.Match) -> bool:
    return len(m.group(2)) >= 6


# fixed patterns: assignments, access keys and hex strings, as the contract of the query states them
BASE = (
    Rule(
        "assign",
        1,
        r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        _long_value,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", None, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
# own rules: private key blocks and signed web tokens
EXTRA = (
    Rule("keyblock", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", None, ("private key-----",)),
    # from the start of a run of such letters only: one attempt per run, however often it repeats the mark
    Rule("webtoken", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None, ("eyj",)),
)
RULES = BASE + EXTRA
LEDGER = "blob binary, rules array<string>, spans array<struct<rule: string, start: int, end: int>>"


def find(text: str, rules: list[Rule]) -> list[tuple[str, int, int]]:
    """(rule key, start, end) of every match that passes its test, by start; code points."""
    low = text.lower()
    out = []
    for r in rules:
        if not r.hints or any(h in low for h in r.hints):
            out += [(m.start(), i, m.end(), r.key) for i, m in enumerate(re.finditer(r.pattern, text)) if r.check is None or r.check(m)]
    return [(key, start, end) for start, _, end, key in sorted(out)]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def scan_unseen(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan the blobs of texts (column text) with the rule versions they lack; append to the ledger. Gives the blobs read."""
    spark = texts.sparkSession
    wanted = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = texts.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if (seen := read_ledger(spark, ledger)) is not None:
        known = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
        blobs = blobs.join(known, "blob", "left")
        blobs = blobs.withColumn("rules", F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>"))))
        blobs = blobs.filter(F.size("rules") > 0)
    else:
        blobs = blobs.withColumn("rules", wanted)
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            todo = b.column(2).to_pylist()
            found = [find(t, [by_key[k] for k in keys]) for t, keys in zip(b.column(1).to_pylist(), todo)]
            spans = [[{"rule": k, "start": s, "end": e} for k, s, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, kind)], ["blob", "rules", "spans"])

    blobs.select("blob", "text", "rules").mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)
    return ledger_rows(spark, ledger).count()


def ledger_rows(spark, ledger: str) -> DataFrame:  # noqa: ANN001
    return spark.read.schema(LEDGER).parquet(ledger)


def read_ledger(spark, ledger: str) -> DataFrame | None:  # noqa: ANN001
    """The ledger's rows, or none where it does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return ledger_rows(spark, ledger) if there else None


def findings(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """paths and spans: array of (start, order, end, kind), by start and then by the order of the rules."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    name = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.name))])
    known = ledger_rows(paths.sparkSession, ledger).filter(F.size("spans") > 0)
    spans = F.array_distinct(F.flatten(F.collect_list("spans")))
    current = F.filter(spans, lambda x: F.array_contains(F.array(*[F.lit(r.key) for r in rules]), x.rule))
    shaped = F.transform(current, lambda x: F.struct(x.start.alias("start"), order[x.rule].alias("order"), x.end.alias("end"), name[x.rule].alias("kind")))
    found = known.groupBy("blob").agg(F.array_sort(shaped).alias("__spans"))
    tagged = paths.drop("spans").withColumn("__blob", blob_of(F.col("text")))
    joined = tagged.join(found, F.col("__blob") == F.col("blob"), "left")
    none = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")
    return joined.withColumn("spans", F.coalesce("__spans", none)).drop("__spans", "__blob", "blob")


def text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
