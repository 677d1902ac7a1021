"""The declarative plan: typed fields, navigation, limits and outputs, checked on construction.

A plan is a small driver-side value. The operators compile it into Column expressions once;
no row interprets it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields
from typing import Any, Protocol
from urllib.parse import urlparse

from siftline.functions import text as txt
from siftline.functions.values import FIELD_TYPES

SCHEMA_VERSION = "plan.v1"
OUTPUTS = ("excel", "csv", "json", "pdf", "docx", "markdown", "txt", "html")
# Size limits of plan parts.
MAX_FIELDS, MAX_OUTPUTS, MAX_ALIASES, MAX_DEDUP_KEYS, MAX_EXPECTATIONS, MAX_NOTES = 64, 8, 10, 5, 64, 32


class PlanError(ValueError):
    """The plan isn't well formed."""

    code = "PLANNER_SCHEMA_ERROR"


class PlanRejected(ValueError):
    """The plan is well formed and not allowed."""

    code = "PLANNER_POLICY_REJECTED"


def _check(good: bool, message: str) -> None:
    if not good:
        raise PlanError(message)


def _sized(value: str | None, most: int, least: int = 0) -> bool:
    return (value is None and least == 0) or (isinstance(value, str) and least <= len(value) <= most)


def _declarative(*values: str | None) -> bool:
    return not re.search(txt.FORBIDDEN_PATTERN, " ".join(v or "" for v in values))


@dataclass(frozen=True)
class PlanField:
    name: str
    type: str
    label: str
    description: str = "-"
    required: bool = False
    aliases: tuple[str, ...] = ()
    example_value: str | None = None
    normalization_hint: str | None = None

    def __post_init__(self):
        _check(re.fullmatch(r"[a-z][a-z0-9_]{0,63}", self.name) is not None, f"unsafe field name {self.name!r}")
        _check(self.type in FIELD_TYPES, f"unknown field type {self.type!r}")
        _check(_sized(self.label, 120, 1) and _sized(self.description, 500, 1), f"label or description of {self.name}")
        _check(_sized(self.example_value, 200) and _sized(self.normalization_hint, 300), f"example or hint of {self.name}")
        _check(len(self.aliases) <= MAX_ALIASES, f"too many aliases of {self.name}")
        _check(_declarative(self.label, self.description, self.normalization_hint, *self.aliases), f"{self.name} isn't declarative")

    def names(self) -> list[str]:
        """What a source may call this field: lower case, distinct, sorted."""
        return sorted({x.lower() for x in (self.name, self.label, *self.aliases) if x})


@dataclass(frozen=True)
class Navigation:
    max_pages: int = 20
    follow_pagination: bool = False
    follow_relevant_links: bool = False
    pagination_likely: bool = False
    relevant_link_purpose: str | None = None

    def __post_init__(self):
        _check(self.max_pages >= 1, "max_pages")
        _check(_sized(self.relevant_link_purpose, 300) and _declarative(self.relevant_link_purpose), "relevant_link_purpose")


@dataclass(frozen=True)
class Deduplication:
    enabled: bool = True
    keys: tuple[str, ...] = ()

    def __post_init__(self):
        _check(len(self.keys) <= MAX_DEDUP_KEYS, "too many deduplication keys")


@dataclass(frozen=True)
class Expectation:
    field: str
    rule: str

    def __post_init__(self):
        _check(_sized(self.field, 64, 1) and _sized(self.rule, 300, 1) and _declarative(self.rule), "expectation")


@dataclass(frozen=True)
class Validation:
    enabled: bool = True
    expectations: tuple[Expectation, ...] = ()

    def __post_init__(self):
        _check(len(self.expectations) <= MAX_EXPECTATIONS, "too many expectations")


@dataclass(frozen=True)
class Limits:
    max_pages: int = 20
    max_records: int = 1000

    def __post_init__(self):
        _check(self.max_pages >= 1 and self.max_records >= 1, "limits")


@dataclass(frozen=True)
class Assumption:
    statement: str
    confidence: str = "medium"

    def __post_init__(self):
        _check(_sized(self.statement, 500, 1) and self.confidence in ("low", "medium", "high"), "assumption")


@dataclass(frozen=True)
class Plan:
    source_url: str
    summary: str
    fields: tuple[PlanField, ...]
    scope: str = "site"
    objective: str = "structured_records"
    navigation: Navigation = field(default_factory=Navigation)
    deduplication: Deduplication = field(default_factory=Deduplication)
    validation: Validation = field(default_factory=Validation)
    limits: Limits = field(default_factory=Limits)
    outputs: tuple[str, ...] = ("json",)
    assumptions: tuple[Assumption, ...] = ()
    ambiguities: tuple[str, ...] = ()
    plan_version: int = 1
    schema_version: str = SCHEMA_VERSION

    def __post_init__(self):
        parsed = urlparse(self.source_url)
        _check(parsed.scheme in ("http", "https") and bool(parsed.netloc), "source URL must be absolute http(s)")
        _check(self.schema_version == SCHEMA_VERSION and self.plan_version >= 1, "version")
        _check(self.scope in ("site", "page") and self.objective == "structured_records", "scope or objective")
        _check(_sized(self.summary, 500, 1) and _declarative(self.summary), "summary")
        names = [f.name for f in self.fields]
        _check(len(names) <= MAX_FIELDS and len(set(names)) == len(names), "field names must be unique, at most 64")
        _check(set(self.outputs) <= set(OUTPUTS) and len(set(self.outputs)) == len(self.outputs), "outputs")
        _check(bool(self.fields) or bool(self.ambiguities), "no field and no ambiguity")
        _check(self.navigation.max_pages == self.limits.max_pages, "page limits disagree")
        _check(len(self.assumptions) <= MAX_NOTES and len(self.ambiguities) <= MAX_NOTES, "too many notes")
        _check(all(_sized(a, 500, 1) for a in self.ambiguities), "ambiguity")

    def document(self) -> dict[str, Any]:
        """The nested plan.v1 document."""
        plain = asdict(self)
        source = {"url": plain.pop("source_url"), "scope": plain.pop("scope")}
        intent = {"summary": plain.pop("summary"), "objective": plain.pop("objective")}
        plain["ambiguities"] = [{"message": m} for m in plain["ambiguities"]]
        return plain | {"source": source, "intent": intent}

    def canonical_json(self) -> str:
        return json.dumps(self.document(), sort_keys=True, separators=(",", ":"), ensure_ascii=True)

    def hash(self) -> str:
        return hashlib.sha256(self.canonical_json().encode()).hexdigest()

    def type_of(self, name: str) -> str:
        return next(f.type for f in self.fields if f.name == name)


def _made(kind: type, value: Any) -> Any:
    """A dataclass from a mapping with exactly its names; strings are stripped."""
    _check(isinstance(value, dict), f"{kind.__name__} must be an object")
    known = {f.name for f in fields(kind)}
    _check(set(value) <= known, f"unknown keys {sorted(set(value) - known)}")
    clean = {k: tuple(v) if isinstance(v, list) else v.strip() if isinstance(v, str) else v for k, v in value.items()}
    try:
        return kind(**clean)
    except TypeError as e:
        raise PlanError(str(e)) from e


def read_plan(raw: Any) -> Plan:
    """A Plan from a plan.v1 document (mapping or JSON text)."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise PlanError("not JSON") from e
    _check(isinstance(raw, dict), "a plan is an object")
    rest = dict(raw)
    source, intent = rest.pop("source", {}), rest.pop("intent", {})
    _check(isinstance(source, dict) and set(source) <= {"url", "scope"}, "source")
    _check(isinstance(intent, dict) and set(intent) <= {"summary", "objective"}, "intent")
    parts = {
        "source_url": source.get("url"),
        "scope": source.get("scope", "site"),
        "summary": intent.get("summary"),
        "objective": intent.get("objective", "structured_records"),
    }
    _check(isinstance(parts["source_url"], str), "source URL")
    nested = {"navigation": Navigation, "deduplication": Deduplication, "limits": Limits}
    for name, kind in nested.items():
        if name in rest:
            parts[name] = _made(kind, rest.pop(name))
    if "validation" in rest:
        v = rest.pop("validation")
        _check(isinstance(v, dict) and set(v) <= {"enabled", "expectations"}, "validation")
        parts["validation"] = Validation(v.get("enabled", True), tuple(_made(Expectation, e) for e in v.get("expectations", ())))
    parts["fields"] = tuple(_made(PlanField, f) for f in rest.pop("fields", ()))
    parts["assumptions"] = tuple(_made(Assumption, a) for a in rest.pop("assumptions", ()))
    notes = rest.pop("ambiguities", ())
    _check(all(isinstance(a, dict) and set(a) == {"message"} for a in notes), "ambiguities")
    parts["ambiguities"] = tuple(a["message"] for a in notes)
    parts["outputs"] = tuple(rest.pop("outputs", ("json",)))
    known = {"plan_version", "schema_version"}
    _check(set(rest) <= known, f"unknown keys {sorted(set(rest) - known)}")
    return Plan(**parts, **rest)


def canonical_outputs(outputs: Sequence[str]) -> list[str]:
    plain = [o.lower().lstrip(".") for o in outputs]
    return [txt.FORMAT_ALIASES.get(o, o) for o in plain]


@dataclass(frozen=True)
class Request:
    """What a user asks for; limits are checked on construction."""

    source_url: str
    task: str
    fields: tuple[str, ...]
    output_formats: tuple[str, ...]
    max_pages: int = 20
    max_records: int = 1000
    follow_pagination: bool = True
    follow_relevant_links: bool = False
    extract_images: bool = False
    deduplicate: bool = True
    validate: bool = True

    def __post_init__(self):
        _check(1 <= self.max_pages <= 100 and 1 <= self.max_records <= 10_000, "page or record limit")
        _check(16 <= len(self.task) <= 10_000, "task length")
        named = [f.strip() for f in self.fields]
        _check(1 <= len(named) <= 100 and all(named) and len({f.lower() for f in named}) == len(named), "fields")
        formats = canonical_outputs(self.output_formats)
        _check(1 <= len(formats) <= 7 and len(set(formats)) == len(formats), "output formats")
        _check(set(formats) <= set(OUTPUTS), f"unsupported formats {sorted(set(formats) - set(OUTPUTS))}")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def normalise_task(task: str, most: int = 10_000) -> str:
    """The task in single spaces; refused if it is empty, too long or tries to give instructions."""
    plain = " ".join(task.split())
    if not plain or len(plain) > most:
        raise PlanRejected("the task is empty or too long")
    if re.search(txt.INJECTION_PATTERN, plain):
        raise PlanRejected("the task contains unsafe instructions")
    return plain


def check_plan(plan: Plan, request: Request, *, max_pages: int = 100, max_records: int = 10_000, max_fields: int = 64, max_outputs: int = 7) -> Plan:
    """The plan, if it stays within the server's and the request's bounds."""
    if len(plan.fields) > max_fields or len(plan.outputs) > max_outputs:
        raise PlanError("more fields or outputs than the server allows")
    nav, limits = plan.navigation, plan.limits
    unchanged = {
        "plan version": plan.plan_version == 1,
        "source URL": plan.source_url == request.source_url,
        "server limits": limits.max_pages <= max_pages and limits.max_records <= max_records,
        "output formats": list(plan.outputs) == canonical_outputs(request.output_formats),
        "resource limits": (limits.max_pages, limits.max_records) == (request.max_pages, request.max_records),
        "pagination": nav.follow_pagination == request.follow_pagination,
        "relevant links": nav.follow_relevant_links == request.follow_relevant_links,
        "deduplication": plan.deduplication.enabled == request.deduplicate,
        "validation": plan.validation.enabled == request.validate,
    }
    if changed := [name for name, same in unchanged.items() if not same]:
        raise PlanRejected(f"the plan alters: {', '.join(changed)}")
    return plan


class PlanProvider(Protocol):
    def generate(self, request: Request, schema: dict[str, Any]) -> Any: ...


@dataclass(frozen=True)
class FixedProvider:
    """Gives the same document, or raises the same error, each time."""

    output: Any

    def generate(self, request: Request, schema: dict[str, Any]) -> Any:
        if isinstance(self.output, Exception):
            raise self.output
        return self.output


@dataclass(frozen=True)
class UnavailableProvider:
    """Stands where no provider is configured; it never falls back to another."""

    message: str = "no plan provider is configured"

    def generate(self, request: Request, schema: dict[str, Any]) -> Any:
        raise PlanRejected(self.message)


def provider_for(settings: dict[str, Any]) -> PlanProvider:
    return FixedProvider(settings["plan"]) if settings.get("provider") == "fixed" else UnavailableProvider()


def make_plan(request: Request, provider: PlanProvider, **bounds: int) -> Plan:
    normalise_task(request.task)
    return check_plan(read_plan(provider.generate(request, strict_schema(plan_schema()))), request, **bounds)


def plan_schema() -> dict[str, Any]:
    """A JSON schema of the field list and outputs, for providers that want one."""
    item = {
        "type": "object",
        "properties": {
            "name": {"type": "string"},
            "type": {"enum": list(FIELD_TYPES)},
            "label": {"type": "string"},
            "description": {"type": "string"},
            "required": {"type": "boolean"},
            "aliases": {"type": "array", "items": {"type": "string"}},
        },
    }
    return {
        "type": "object",
        "properties": {
            "schema_version": {"const": SCHEMA_VERSION},
            "fields": {"type": "array", "items": item},
            "outputs": {"type": "array", "items": {"enum": list(OUTPUTS)}},
        },
    }


def strict_schema(schema: Any) -> Any:
    """The schema with every object closed and all its properties required, at any depth."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) for k, v in schema.items() if k != "default"}
    if isinstance(out.get("properties"), dict):
        out |= {"additionalProperties": False, "required": list(out["properties"])}
    return out


