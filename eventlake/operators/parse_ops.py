"""Parse operators: each compiles one pack step to Column expressions.

An operator writes fields into a FieldSet and returns an error Column (NULL = fine) or
None when it cannot fail. Nothing raises on executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlake.functions import regexes, timefmt
from eventlake.functions.regexes import quote
from eventlake.operators.fieldset import FieldSet, Value, choose, empty_map

Spec = dict[str, Any]
Dictionaries = dict[str, dict[str, str]]
Builder = Callable[[FieldSet, Spec, Dictionaries], "Column | None"]

_REGISTRY: dict[str, Builder] = {}

# Unicode white space, for splitting on it
_SPACE = r"[\s\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_SPACE_CHARS = " \t\n\x0b\x0c\r\x85\xa0"


class PackError(ValueError):
    """A pack that cannot be compiled."""


def operator(name: str) -> Callable[[Builder], Builder]:
    """Register a parse operator under a pack name (also the extension point)."""

    def add(fn: Builder) -> Builder:
        _REGISTRY[name] = fn
        return fn

    return add


def operator_names() -> list[str]:
    return sorted(_REGISTRY)


def apply_operator(fs: FieldSet, spec: Spec, dictionaries: Dictionaries) -> Column | None:
    try:
        build = _REGISTRY[spec["op"]]
    except KeyError:
        raise PackError(f"unknown operator {spec.get('op')!r}") from None
    return build(fs, spec, dictionaries)


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACE_CHARS))


def fail_if(cond: Column, message: str) -> Column:
    return F.when(cond, F.lit(message))


# --- syslog ------------------------------------------------------------------------


@operator("syslog")
def _syslog(fs: FieldSet, spec: Spec, _: Dictionaries) -> None:
    pri_text = F.nullif(F.regexp_extract(fs.raw, r"\A<([+-]?\d{1,18})>", 1), F.lit(""))
    pri = fs.stage(pri_text.cast("long"))
    rest = fs.stage(F.when(pri.isNotNull(), F.regexp_replace(fs.raw, r"\A<[+-]?\d{1,18}>", "")).otherwise(fs.raw))
    for name, number in (("pri", pri), ("facility", timefmt.idiv(pri, 8)), ("severity", pri % F.lit(8))):
        fs.set(name, number.cast("string"), number)

    modern = rest.startswith("1 ")
    new, old = fs.clone(), fs.clone()
    _rfc5424(new, fs.stage(F.when(modern, F.substring(rest, 3, 1 << 30))))
    old.level = new.level
    _rfc3164(old, rest)
    fs.level = max(new.level, old.level)
    for name in {**new.static, **old.static}:
        if name not in ("pri", "facility", "severity"):
            fs.set(name, choose(modern, new.get(name), old.get(name)).text)


def _rfc5424(fs: FieldSet, body: Column) -> None:
    """timestamp host app procid msgid, then `-` or `[data] `, then the message."""
    tok = r" *([^ ]+)"
    names = ["timestamp", "hostname", "appname", "procid", "msgid"]
    # every token is optional from the right, so short headers keep what they have
    pattern = rf"\A{tok}(?:(?: +|\z){tok}(?:(?: +|\z){tok}(?:(?: +|\z){tok}(?:(?: +|\z){tok})?)?)?)?"
    java = regexes.JavaPattern(pattern, tuple(names))
    head = fs.stage(regexes.capture_all(body, java))
    some = F.size(head) > 1
    for i, name in enumerate(names, 1):
        fs.set(name, F.when(some, F.nullif(F.get(head, F.lit(i)), F.lit(""))))
    five = fs.get("msgid").text.isNotNull()
    rest = fs.stage(F.when(five, F.regexp_replace(body, r"(?s)\A *(?:[^ ]+(?: +|\z)){5}", "")))
    end = F.locate("] ", rest)
    data = rest.startswith("[") & (end > 0)
    fs.set("structured_data", F.when(data, F.substring(rest, F.lit(1), end)))
    fs.set(
        "message",
        F.when(data, F.substring(rest, end + F.lit(2), F.length(rest)))
        .when(rest.startswith("-"), F.regexp_replace(rest, r"\A- ", ""))
        .when(five, rest)
        .when(~some, body),
    )


def _rfc3164(fs: FieldSet, body: Column) -> None:
    """month day [year] time host tag: message."""
    words = fs.stage(F.filter(F.split(body, rf"{_SPACE}+", 7), lambda w: w != ""))
    enough = F.size(words) >= 4
    # four digits are a year only where a time follows: any other line may have a number as its third word
    dated = F.get(words, F.lit(2)).rlike(r"\A[0-9]{4}\z") & F.get(words, F.lit(3)).rlike(r"\A[0-9]{1,2}:[0-9]{2}")
    year = (F.size(words) >= 5) & F.coalesce(dated, F.lit(False))
    stamp = F.when(year, F.array_join(F.slice(words, 1, 4), " ")).otherwise(F.array_join(F.slice(words, 1, 3), " "))
    fs.set("timestamp", F.when(enough, stamp))

    def after(n: int) -> Column:
        return F.regexp_extract(body, rf"(?s)\A *(?:[^ ]+ +){{{n}}}([^ ].*)\z", 1)

    rest = fs.stage(F.when(enough, F.when(year, after(4)).otherwise(after(3))))
    host = F.nullif(F.substring_index(rest, " ", 1), F.lit(""))
    tail = fs.stage(F.regexp_replace(rest, r"(?s)\A[^ ]* *", ""))
    colon = F.locate(": ", tail)
    fs.set("hostname", host)
    fs.set("appname", F.when(colon > 0, F.regexp_replace(F.substring(tail, F.lit(1), colon - F.lit(1)), r":\z", "")))
    message = F.when(colon > 0, F.substring(tail, colon + F.lit(2), F.length(tail))).otherwise(tail)
    fs.set("message", F.when(~enough, body).otherwise(message))


# --- text patterns -----------------------------------------------------------------


def _dissect_tokens(pattern: str) -> list[tuple[str, str]]:
    """[("lit", text) | ("field", name)] in pattern order."""
    tokens, pos = [], 0
    while pos < len(pattern):
        start = pattern.find("%", pos)
        if start < 0 or pattern[start + 1 : start + 2] != "{":
            tokens.append(("lit", pattern[pos:]))
            break
        if start > pos:
            tokens.append(("lit", pattern[pos:start]))
        end = pattern.find("}", start)
        if end < 0:
            raise PackError(f"dissect: unterminated field in {pattern!r}")
        tokens.append(("field", pattern[start + 2 : end]))
        pos = end + 1
    return tokens


@operator("dissect")
def _dissect(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column | None:
    text = fs.stage(fs.source(spec.get("field")))
    return dissect_into(fs, text, _dissect_tokens(spec.get("pattern", "")))


def dissect_into(fs: FieldSet, text: Column, tokens: list[tuple[str, str]]) -> Column:
    """Walk the literals left to right, each searched forward from the end of the last one."""
    pos, alive = F.lit(1), F.lit(True)
    found: Column | None = None  # position of the literal that ends the field before it
    to_end = F.lit(2**31 - 1)
    for i, (kind, value) in enumerate(tokens):
        if kind == "lit":
            if found is None:
                found = fs.stage(F.when(alive, F.position(F.lit(value), text, pos)))
            alive = F.coalesce(found > 0, F.lit(False))
            pos = found + F.lit(len(value))
            found = None
        elif value not in ("", "_"):
            if i + 1 < len(tokens) and tokens[i + 1][0] == "lit":
                found = fs.stage(F.when(alive, F.position(F.lit(tokens[i + 1][1]), text, pos)))
                size = F.when(found > 0, found - pos).otherwise(to_end)
                fs.set(value, F.when(alive, F.substring(text, pos, size)))
            else:
                fs.set(value, F.when(alive, F.substring(text, pos, to_end)))
                pos = F.length(text) + F.lit(1)
    return fail_if(~alive, "dissect: literal not found")


@operator("regex")
def _regex(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    return _capture(fs, spec, spec.get("pattern", ""))


def _capture(fs: FieldSet, spec: Spec, pattern: str) -> Column:
    java = regexes.to_java(pattern)
    groups = fs.stage(regexes.capture_all(fs.source(spec.get("field")), java))
    hit = F.size(groups) > 1
    for i, name in enumerate(java.names, 1):
        if name:
            fs.set(name, F.when(hit, F.get(groups, F.lit(i))))
    return fail_if(~hit, "regex: no match")


# The named patterns packs may use.
GROK = {
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "IPORHOST": r"[a-zA-Z0-9_.:-]+",
    "INT": r"-?\d+",
    "NUMBER": r"-?\d+(?:\.\d+)?",
    "WORD": r"\w+",
    "NOTSPACE": r"\S+",
    "GREEDYDATA": r".*",
    "DATA": r".*?",
    "HOSTNAME": r"[a-zA-Z0-9.-]+",
    "TIMESTAMP": r"[A-Za-z]{3}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}",
}


def expand_grok(pattern: str) -> str:
    def one(m: re.Match) -> str:
        name, target = m.group(1), m.group(2)
        if name not in GROK:
            raise PackError(f"grok: unknown pattern {name}")
        return f"(?P<{target}>{GROK[name]})" if target else f"(?:{GROK[name]})"

    return re.sub(r"%\{(\w+)(?::(\w+))?\}", one, pattern)


@operator("grok")
def _grok(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    return _capture(fs, spec, expand_grok(spec.get("pattern", "")))


# --- structured bodies -------------------------------------------------------------


@operator("json")
def _json(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    """Top-level object; nested values stay JSON text, nulls count as absent.

    Read as the only element of an array, so text behind the object makes the line fail instead of being dropped.
    """
    text = trim_space(fs.source(spec.get("field")))
    whole = text.startswith("{") & text.endswith("}")
    docs = fs.stage(F.when(whole, F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>")))
    doc = fs.stage(F.when(F.size(docs) == 1, F.get(docs, F.lit(0))))
    fs.merge_map(doc)
    return fail_if(doc.isNull(), "json: not an object")


@operator("csv")
def _csv(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    text = fs.source(spec.get("field"))
    sep = (spec.get("delimiter") or ",")[0]
    columns = spec.get("columns") or []
    values = fs.stage(split_csv(text, sep))
    for i, name in enumerate(columns):
        if name and name != "_":
            fs.set(name, F.get(values, F.lit(i)))
    n = len(columns)
    extra = F.when(
        F.size(values) > n,
        F.map_from_entries(
            F.transform(
                F.slice(values, F.lit(n + 1), F.size(values)),
                lambda v, i: F.struct(F.concat(F.lit("col_"), (i + F.lit(n + 1)).cast("string")), v),
            )
        ),
    )
    fs.merge_overflow(extra)
    return fail_if(values.isNull(), "csv: malformed record")


def split_csv(text: Column, sep: str) -> Column:
    """Values of the first CSV record, NULL when it is malformed or empty.

    Text without quotes and line breaks is a plain split. Otherwise one regex checks the
    record (quotes only around a whole value, doubled inside) and another takes the values.
    """
    q = quote(sep)
    plain = F.split(text, q, -1)
    value = rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{q}\n]*+)'
    body = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\A\n+", "")
    record = F.regexp_extract(body, rf"\A({value}(?:{q}{value})*+)(?:\n|\z)", 1)
    good = body.rlike(rf"\A{value}(?:{q}{value})*+(?:\n|\z)") & (body != "")
    cells = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf"{q}({value})"), F.lit(1))
    unquoted = F.transform(
        cells,
        lambda c: F.when(
            c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - F.lit(2)), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )
    return F.when(text.rlike(r'["\r\n]') | (text == ""), F.when(good, unquoted)).otherwise(plain)


def split_pairs(text: Column, sep: str) -> Column:
    """Pieces between separators that are outside double quotes (an open quote runs to the end)."""
    q = quote(sep)
    return F.regexp_extract_all(text, F.lit(rf'(?:[^"{q}]++|"[^"]*+"?+)++'), F.lit(0))


def pairs_to_map(pairs: Column, kv_sep: str, strip_quotes: bool, keep_blank: bool) -> Column:
    def entry(pair: Column) -> Column:
        at = F.position(F.lit(kv_sep), pair)
        key = trim_space(F.substring(pair, F.lit(1), at - F.lit(1)))
        val = F.substring(pair, at + F.lit(len(kv_sep)), F.length(pair))
        return F.struct(key.alias("k"), (F.btrim(val, F.lit('"')) if strip_quotes else val).alias("v"))

    entries = F.transform(F.filter(pairs, lambda p: p.contains(kv_sep)), entry)
    if not keep_blank:
        entries = F.filter(entries, lambda e: e["k"] != "")
    return F.map_from_entries(entries)


@operator("kv")
def _kv(fs: FieldSet, spec: Spec, _: Dictionaries) -> None:
    pair_sep, kv_sep = (spec.get("pair_sep") or " ")[0], spec.get("kv_sep") or "="
    pairs = split_pairs(fs.source(spec.get("field")), pair_sep)
    fs.merge_map(fs.stage(pairs_to_map(pairs, kv_sep, strip_quotes=True, keep_blank=False)))


@operator("xml")
def _xml(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    """Leaf text at root.child…, attributes at path_attr; element names are free, so a Pandas UDF flattens."""
    from eventlake.functions.xmlmap import xml_to_map

    doc = fs.stage(xml_to_map(fs.source(spec.get("field"))))
    fs.merge_map(doc)
    return fail_if(doc.isNull(), "xml: not well formed")


# --- security formats --------------------------------------------------------------

# Header field names in wire order.
CEF_HEADER = "cef_version device_vendor device_product device_version signature_id name severity".split()
LEEF_HEADER = "leef_version device_vendor device_product device_version event_id".split()


@operator("cef")
def _cef(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    text = fs.source(spec.get("field"))
    parts = fs.stage(F.when(text.startswith("CEF:"), F.split(F.substring(text, 5, 1 << 30), r"(?<!\\)\|", 8)))
    good = F.size(parts) >= 7

    def part(i: int) -> Column:
        return F.when(good, F.replace(F.get(parts, F.lit(i)), F.lit("\\|"), F.lit("|")))

    for i, name in enumerate(CEF_HEADER):
        fs.set(name, part(i))
    if spec.get("spec_values"):
        ext = _spec_extension(part(7))
    else:
        ext = pairs_to_map(split_pairs(part(7), " "), "=", strip_quotes=False, keep_blank=True)
    fs.merge_map(fs.stage(ext))
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("cef: bad header"))


def _spec_extension(ext: Column) -> Column:
    """Optional mode: a value runs to the next ` key=`, so it may hold spaces."""
    marked = F.regexp_replace(ext, r" +(?=[^ =\\]+=)", regexes.GROUP_SEP)
    return pairs_to_map(F.split(marked, regexes.GROUP_SEP), "=", strip_quotes=False, keep_blank=True)


@operator("leef")
def _leef(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    text = fs.source(spec.get("field"))
    parts = fs.stage(F.when(text.startswith("LEEF:"), F.split(F.substring(text, 6, 1 << 30), r"\|", 6)))
    good = F.size(parts) >= 5
    for i, name in enumerate(LEEF_HEADER):
        fs.set(name, F.when(good, F.get(parts, F.lit(i))))
    body = F.get(parts, F.lit(5))
    explicit = F.get(parts, F.lit(0)).startswith("2.0")
    # version 2.0 may name a one-character separator before the extension
    cut = F.position(F.lit("|"), body)
    ext = F.when(explicit & (cut > 0), F.substring(body, cut + F.lit(1), F.length(body))).otherwise(body)
    sep = F.when(explicit & (cut == 2), F.substring(body, 1, 1)).otherwise(F.lit("\t"))
    # rewrite separators outside quotes to a tab so one splitter serves every row
    pieces = F.when(sep == "\t", split_pairs(ext, "\t")).otherwise(
        F.regexp_extract_all(
            ext, F.concat(F.lit('(?:[^"\\Q'), sep, F.lit('\\E]++|"[^"]*+"?+)++')), F.lit(0)
        )
    )
    fs.merge_map(fs.stage(pairs_to_map(F.when(good, pieces), "=", strip_quotes=False, keep_blank=True)))
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("leef: bad header"))


# --- value transforms --------------------------------------------------------------

_TRUE = ["1", "t", "T", "TRUE", "true", "True"]
_FALSE = ["0", "f", "F", "FALSE", "false", "False"]
_FLOAT = r"\A[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\z"


def to_int(text: Column) -> Column:
    return text.try_cast("long")  # the cast ignores surrounding white space


def to_float(text: Column) -> Column:
    t = trim_space(text)
    return F.when(t.rlike(_FLOAT), F.regexp_replace(t, "(?i)inf(?!inity)", "Infinity").try_cast("double"))


def to_bool(text: Column) -> Column:
    t = trim_space(text)
    return F.when(t.isin(_TRUE), F.lit(True)).when(t.isin(_FALSE), F.lit(False))


def float_text(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.0\z", "")


@operator("date")
def _date(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    layouts = spec.get("formats") or []
    if not layouts:
        raise PackError("date: no formats given")
    name = spec.get("field", "")
    text = fs.text(name)
    ts = F.coalesce(*[timefmt.parse_layout(text, layout, spec.get("timezone")) for layout in layouts])
    ns = fs.stage(timefmt.to_ns(ts))
    fs.set(spec.get("as") or f"{name}_epoch_ns", ns.cast("string"), ns)
    return fail_if(ns.isNull(), f"date: {name} does not match")


@operator("convert")
def _convert(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column | None:
    name = spec.get("field", "")
    target = spec.get("as") or name
    kind = spec.get("type") or "string"
    text = fs.text(name)
    if kind == "string":
        fs.set(target, text)
        return None
    if kind == "int":
        value = to_int(text)
        fs.set(target, value.cast("string"), value)
    elif kind == "float":
        value = to_float(text)
        fs.set(target, float_text(value))
    elif kind == "bool":
        value = to_bool(text)
        fs.set(target, value.cast("string"))
    else:
        return F.lit(f"convert: unknown type {kind}")
    return fail_if(value.isNull(), f"convert: {name} is not {kind}")


@operator("lookup")
def _lookup(fs: FieldSet, spec: Spec, dictionaries: Dictionaries) -> None:
    name = spec.get("field", "")
    table = dictionaries.get(spec.get("dictionary", ""), {})
    found = literal_lookup(table, fs.text(name))
    fs.put(spec.get("as") or name, Value(F.coalesce(found, F.lit(spec.get("default") or ""))))


def literal_lookup(table: dict[str, str], key: Column) -> Column:
    """Dictionary values as a literal map: packs ship small tables."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def _from_to(spec: Spec) -> tuple[str, str]:
    src, dst = spec.get("from") or spec.get("field"), spec.get("to") or spec.get("as")
    if not src or not dst:
        raise PackError(f"{spec['op']}: needs from and to")
    return src, dst


@operator("rename")
def _rename(fs: FieldSet, spec: Spec, _: Dictionaries) -> None:
    src, dst = _from_to(spec)
    if src != dst:
        value = fs.get(src)
        fs.set(dst, value.text)
        fs.drop(src)


@operator("copy")
def _copy(fs: FieldSet, spec: Spec, _: Dictionaries) -> None:
    src, dst = _from_to(spec)
    fs.set(dst, fs.get(src).text)


@operator("drop_field")
def _drop_field(fs: FieldSet, spec: Spec, _: Dictionaries) -> None:
    if not spec.get("field"):
        raise PackError("drop_field: needs field")
    fs.drop(spec["field"])


@operator("gsub")
def _gsub(fs: FieldSet, spec: Spec, _: Dictionaries) -> None:
    name = spec.get("field", "")
    java = regexes.to_java(spec.get("match", ""))
    with_ = regexes.java_replacement(spec.get("replacement") or "", java.names)
    fs.put(spec.get("as") or name, Value(F.regexp_replace(fs.text(name), java.body, with_)))


@operator("split")
def _split(fs: FieldSet, spec: Spec, _: Dictionaries) -> Column:
    sep, name, index = spec.get("separator"), spec.get("field", ""), spec.get("index") or 0
    if not sep:
        raise PackError("split: needs separator")
    piece = F.get(F.split(fs.text(name), quote(sep), -1), F.lit(index)) if index >= 0 else F.lit(None).cast("string")
    fs.set(spec.get("as") or name, piece)
    return fail_if(piece.isNull(), f"split: index {index} out of range")


@operator("conditional")
def _conditional(fs: FieldSet, spec: Spec, dictionaries: Dictionaries) -> Column:
    """Run `then` or `else`; the first operator that fails ends the branch."""
    if not spec.get("when"):
        raise PackError("conditional: needs when")
    hit = fs.stage(predicate(fs.source(spec.get("field")), spec["when"]))
    then, other = fs.clone(), fs.clone()
    then_error = _run_branch(then, spec.get("then") or [], dictionaries)
    other.level = then.level
    other_error = _run_branch(other, spec.get("else") or [], dictionaries)
    fs.level = other.level
    for name in {**then.static, **other.static}:
        a, b = then.get(name), other.get(name)
        if a is not b:
            fs.static[name] = choose(hit, a, b)
    if then.dynamic is not other.dynamic:
        a = then.dynamic if then.dynamic is not None else empty_map()
        b = other.dynamic if other.dynamic is not None else empty_map()
        fs.dynamic = F.when(hit, a).otherwise(b)
    else:
        fs.dynamic = then.dynamic
    return F.when(hit, then_error).otherwise(other_error)


def _run_branch(fs: FieldSet, specs: list[Spec], dictionaries: Dictionaries) -> Column:
    error = F.lit(None).cast("string")
    for sub in specs:
        before = fs.clone()
        sub_error = apply_operator(fs, sub, dictionaries)
        fs.restore_where(error.isNotNull(), before)
        if sub_error is not None:
            error = F.coalesce(error, sub_error)
    return error


def predicate(text: Column, spec: Spec) -> Column:
    """Exactly one of contains, prefix, regex, in that precedence."""
    if spec.get("contains"):
        return text.contains(spec["contains"])
    if spec.get("prefix"):
        return text.startswith(spec["prefix"])
    if spec.get("regex"):
        return regexes.matches(text, spec["regex"])
    raise PackError("empty predicate")
