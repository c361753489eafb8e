"""Run parser packs over identified lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.operators.fieldset import FieldSet, Stages, empty_map, seal
from eventlake.operators.parse_ops import apply_operator
from eventlake.sources.packs import Pack, PackSet


@dataclass
class ParsedPack:
    pack: Pack
    guard: Column
    fields: FieldSet


def run_steps(raw: Column, steps: list[dict], dictionaries: dict, guard: Column | None = None, stages: Stages | None = None) -> FieldSet:
    """Compile one list of operators. A failing operator is recorded and the rest still run."""
    fs = FieldSet(raw, stages or Stages(), guard)
    for spec in steps:
        # a step that extracts may say which of its fields are numbers: {types: {field: int}}
        typed = [{"op": "convert", "field": name, "type": kind} for name, kind in (spec.get("types") or {}).items()]
        for one in (spec, *typed):
            error = apply_operator(fs, one, dictionaries)
            if error is not None:
                fs.errors.append(error)
    return fs


def compile_packs(df: DataFrame, packs: PackSet, text: str = "raw") -> tuple[DataFrame, list[ParsedPack]]:
    """Add the shared intermediate columns of every pack; each row pays only for its own parser."""
    stages = Stages()
    parsed = []
    ordered = packs.ordered()
    # rows compare a small number, not the parser name, in every CASE
    number = F.lit(-1)
    for i, pack in enumerate(ordered):
        number = F.when(F.col("parser_id") == F.lit(pack.id), F.lit(i)).otherwise(number)
    df = df.withColumn("__pack", number)
    for i, pack in enumerate(ordered):
        guard = F.col("__pack") == F.lit(i)
        parsed.append(ParsedPack(pack, guard, run_steps(F.col(text), pack.steps, packs.dictionaries, guard, stages)))
    return stages.apply(df), parsed


def by_pack(parsed: list[ParsedPack], value, default: Column) -> Column:
    """CASE over parsers; packs for which `value` gives None fall to the default."""
    branches = [(p.guard, value(p)) for p in parsed]
    branches = [(g, v) for g, v in branches if v is not None]
    if not branches:
        return default
    case = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
    return case.otherwise(default)


def parse(df: DataFrame, packs: PackSet, text: str = "raw") -> DataFrame:
    """Add fields MAP, parse_errors and parse_status to rows that carry parser_id."""
    before = df.columns
    df, parsed = compile_packs(df, packs, text)
    out = df.select(
        *before,
        by_pack(parsed, lambda p: p.fields.to_map(), empty_map()).alias("fields"),
        by_pack(parsed, lambda p: p.fields.error_list(), F.array().cast("array<string>")).alias("parse_errors"),
        by_pack(parsed, lambda p: p.fields.status(), F.lit("failed")).alias("parse_status"),
    )
    return seal(out, ["fields", "parse_errors", "parse_status"])


def extract(df: DataFrame, steps: list[dict], dictionaries: dict | None = None, text: str = "raw", names: list[str] | None = None) -> DataFrame:
    """Apply operators to every row: fields MAP (or the named fields as columns), errors, status."""
    before = df.columns
    stages = Stages()
    fs = run_steps(F.col(text), steps, dictionaries or {}, None, stages)
    df = stages.apply(df)
    out = [fs.get(n).text.alias(n) for n in names] if names is not None else [fs.to_map().alias("fields")]
    result = df.select(*before, *out, fs.error_list().alias("parse_errors"), fs.status().alias("parse_status"))
    return seal(result, [c for c in result.columns if c not in before])
