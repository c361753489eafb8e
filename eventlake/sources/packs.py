"""Parser packs, mappings and dictionaries: data files read on the driver, compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from eventlake.operators.parse_ops import PackError
from eventlake.schema import BY_PATH

CONFIG_DIR = Path(__file__).resolve().parent.parent / "config"


@dataclass(frozen=True)
class Pack:
    id: str
    version: str = ""
    vendor: str = ""
    product: str = ""
    observer_type: str = ""
    event_class: str = ""
    priority: int = 0
    confidence: float = 1.0
    all: list[dict] = field(default_factory=list)
    any: list[dict] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)
    on_failure: str = "emit_partial"


@dataclass(frozen=True)
class Mapping:
    parser_id: str
    fields: dict[str, dict[str, Any]]

    @property
    def consumed(self) -> set[str]:
        return {m["from"] for m in self.fields.values() if m.get("from") and not m.get("const")}


@dataclass(frozen=True)
class PackSet:
    packs: list[Pack]
    mappings: dict[str, Mapping]
    dictionaries: dict[str, dict[str, str]]

    def ordered(self) -> list[Pack]:
        """Match order: priority, then id so that equal priorities are deterministic."""
        return sorted(self.packs, key=lambda p: (-p.priority, p.id))

    def only(self, *parser_ids: str) -> "PackSet":
        return PackSet([p for p in self.packs if p.id in parser_ids], self.mappings, self.dictionaries)

    def with_pack(self, pack: Pack, mapping: Mapping | None = None) -> "PackSet":
        maps = {**self.mappings, **({pack.id: mapping} if mapping else {})}
        return PackSet([p for p in self.packs if p.id != pack.id] + [pack], maps, self.dictionaries)


def parse_pack(doc: dict) -> Pack:
    meta, match = doc.get("metadata") or {}, doc.get("match") or {}
    if not meta.get("id"):
        raise PackError("pack without metadata.id")
    known = {k: str(meta[k]) for k in ("id", "version", "vendor", "product", "observer_type", "event_class") if k in meta}
    return Pack(
        **known,
        priority=int(match.get("priority") or 0),
        confidence=float(match.get("confidence") or 1.0),
        all=match.get("all") or [],
        any=match.get("any") or [],
        steps=doc.get("pipeline") or [],
        on_failure=doc.get("on_failure") or "emit_partial",
    )


def parse_mapping(doc: dict, parser_id: str | None = None) -> Mapping:
    """Accepts flat paths (`fields: {src.ip: …}`) or nested namespaces."""
    body = doc.get("fields") or doc
    fields: dict[str, dict] = {}
    for key, spec in body.items():
        if "." in key:
            fields[key] = spec
        else:
            fields.update({f"{key}.{leaf}": leaf_spec for leaf, leaf_spec in spec.items()})
    for path in fields:
        if path not in BY_PATH or not BY_PATH[path].settable:
            raise PackError(f"mapping for {parser_id}: unknown target path {path}")
    return Mapping(parser_id or doc["metadata"]["parser_id"], fields)


def load_packs(directory: str | Path | None = None, dictionaries: str | Path | None = None) -> PackSet:
    """Every pack below a directory. A mapping is a `mapping:` section or a `*.mapping.yaml` file."""
    root = Path(directory) if directory else CONFIG_DIR / "packs"
    packs, mappings = [], {}
    for path in sorted(root.rglob("*.y*ml")):
        if ".golden." in path.name:
            continue
        doc = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if ".mapping." in path.name:
            mapping = parse_mapping(doc)
            mappings[mapping.parser_id] = mapping
            continue
        pack = parse_pack(doc)
        packs.append(pack)
        if doc.get("mapping"):
            mappings[pack.id] = parse_mapping(doc["mapping"], pack.id)
    return PackSet(packs, mappings, load_dictionaries(dictionaries))


def load_dictionaries(source: str | Path | None = None) -> dict[str, dict[str, str]]:
    """One file of named tables, or a directory with one table per file."""
    path = Path(source) if source else CONFIG_DIR / "dictionaries.yaml"
    if path.is_dir():
        docs = {p.stem: yaml.safe_load(p.read_text(encoding="utf-8")) or {} for p in sorted(path.glob("*.y*ml"))}
    else:
        docs = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    return {name: {str(k): str(v) for k, v in table.items()} for name, table in docs.items()}
