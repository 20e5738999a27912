"""Settings of adapters: pure functions of what a caller, the environment and the defaults say. Nothing here calls out."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

#: Fixed values.
ON = frozenset({"1", "true", "yes", "on"})
OFF = frozenset({"0", "false", "no", "off", ""})
PRODUCTION = frozenset({"prod", "production"})
MODEL_PROVIDERS = ("openai", "anthropic")
VECTOR_ERROR_WORDS = ("vector", "dimension", "size", "wrong", "not match")
PAYLOAD_INDEXES = {
    "keyword": ("doc_id", "version_id", "doc_type", "chapter_no", "section_no", "article_no", "article_path", "constraint_type", "page_type", "table_repr", "entity_person_ids", "entity_project_ids", "entity_equipment_ids", "rel_person_role", "rel_person_role_project", "clause_id", "clause_no", "clause_node_id", "clause_parent_id", "standard_no", "certificate_no"),
    "integer": ("page_start", "page_end", "clause_level", "val_voltage_kv"),
    "bool": ("is_mandatory",),
    "float": ("val_contract_amount_w", "val_line_length_km", "val_capacity_mva"),
}
DEFAULT_DIM = 1024
REPAIR_DOC_TYPES = ("规范规程",)


def said(value: object) -> str:
    return "" if value is None else str(value).strip()


def first_said(*values: object) -> str:
    """The first value that says something."""
    return next((said(v) for v in values if said(v)), "")


def enabled(value: object, default: bool) -> bool:
    return default if value is None else said(value).lower() not in OFF


def strict(runtime: Mapping, env: Mapping) -> bool:
    """Whether a failed model call must fail, rather than fall back: as told, else in production."""
    told = first_said(runtime.get("embedding_fallback_strict"), env.get("EMBEDDING_FALLBACK_STRICT")).lower()
    return told in ON if told else (first_said(env.get("APP_ENV"), "development").lower() in PRODUCTION)


def stub_dim(pinned: int | None, probed: int | None, default: int = DEFAULT_DIM) -> int:
    """Length of fallback vectors: as pinned, else as the store has it, else the default."""
    return max(1, next((d for d in (pinned, probed) if d and d > 0), default))


def stored_dim(collection: Mapping, name: str = "text_embedding") -> int | None:
    """The vectors' length in a store's description: the named vector's, else the only one's, else any."""
    node: object = collection
    for key in ("result", "config", "params", "vectors"):
        node = node.get(key) if isinstance(node, Mapping) else None
    if not isinstance(node, Mapping):
        return None
    sizes = [x.get("size") if isinstance(x, Mapping) else None for x in (node.get(name), node, *node.values())]
    return next((int(s) for s in sizes if isinstance(s, int | float) and s > 0), None)


@dataclass(frozen=True)
class Endpoint:
    provider: str
    api_key: str
    base_url: str
    model: str


def endpoint(kind: str, runtime: Mapping, env: Mapping, bases: Mapping[str, str], models: Mapping[str, str]) -> Endpoint:
    """Where a service is found: what the caller says, else the environment, else the provider's defaults. Provider `auto`
    is the first of bases if there is a key, else `stub`."""
    upper = kind.upper()
    key = first_said(runtime.get(f"{kind}_api_key"), env.get(f"{upper}_API_KEY"), env.get("OPENAI_API_KEY"))
    provider = first_said(runtime.get(f"{kind}_provider"), env.get(f"{upper}_PROVIDER"), "auto").lower()
    if provider == "auto":
        provider = next(iter(bases), "stub") if key else "stub"
    base = first_said(runtime.get(f"{kind}_base_url"), env.get(f"{upper}_BASE_URL"), env.get("OPENAI_BASE_URL"), bases.get(provider))
    return Endpoint(provider, key, base.rstrip("/"), first_said(runtime.get(f"{kind}_model"), env.get(f"{upper}_MODEL"), models.get(provider)))


def with_defaults(runtime: Mapping, defaults: Mapping[str, Mapping[str, str]]) -> dict:
    """What the caller says, trimmed (providers in lower case, empty values dropped, booleans kept), over the defaults of the
    providers chosen. defaults: service -> its keys without the service's name; `provider` names the one they belong to."""
    out = {k: v if isinstance(v, bool) else said(v).lower() if k.endswith("_provider") else said(v) for k, v in runtime.items() if isinstance(v, bool) or said(v)}
    for service, values in defaults.items():
        provider = out.setdefault(f"{service}_provider", values["provider"])
        if provider == values["provider"]:
            for key, value in values.items():
                out.setdefault(f"{service}_{key}", value)
    return out


def providers(task: str, runtime: Mapping, env: Mapping, policy: Mapping) -> list[str]:
    """Model providers to try in order. One that is named is tried alone; else the caller's key, the tiers of the task
    (by the tier's own setting, its number's, or the general one), and at last the stub."""
    named = first_said(runtime.get("llm_provider"), env.get("LLM_PROVIDER"), "auto").lower()
    if named in (*MODEL_PROVIDERS, "stub"):
        return [named]
    found = [MODEL_PROVIDERS[0]] if said(runtime.get("llm_api_key")) else []
    for tier in (policy.get("tasks") or {}).get(task, ("tier1", "tier2", "tier3")):
        label = said((policy.get("tiers") or {}).get(tier)).upper()
        keys = [*([f"LLM_TIER_PROVIDER_{label}"] if label else []), f"LLM_PROVIDER_{tier.upper()}", "LLM_PROVIDER"]
        found += [p for p in (said(env.get(k)).lower() for k in keys) if p in MODEL_PROVIDERS][:1]
    return list(dict.fromkeys([*found, "stub"]))


def stub_reply(prompt: str) -> dict:
    """What stands in for a model's answer."""
    reply = f"根据证据，问题“{prompt}”的答案请参考引用内容。"
    return {"text": reply, "provider": "stub", "model": "stub-mvp", "tokens_in": len(prompt), "tokens_out": len(reply)}


def is_vector_mismatch(status: int, body: str | None) -> bool:
    """Whether a store refused vectors for their length."""
    return status == 400 and any(w in (body or "").lower() for w in VECTOR_ERROR_WORDS)


def is_recoverable(status: int, body: str | None, may_recreate: bool = False) -> bool:
    """Whether a failed upsert is tried again on a new collection."""
    return status == 404 or (may_recreate and is_vector_mismatch(status, body))


def doc_type_allowed(doc_type: str | None, allowed: str | None = None) -> bool:
    """Whether a document's type is in a list with commas (none: REPAIR_DOC_TYPES; an empty list allows all)."""
    types = [x.strip() for x in allowed.split(",") if x.strip()] if allowed is not None else REPAIR_DOC_TYPES
    return not types or said(doc_type) in types


def keyword_search_on(env: Mapping, scrolled: bool = False) -> bool:
    """Whether the keyword route runs; stores that can only be scrolled have a switch of their own."""
    on = enabled(env.get("HYBRID_KEYWORD_ENABLED"), True)
    return on and (not scrolled or enabled(env.get("ENABLE_QDRANT_SCROLL_KEYWORD"), True))


def notes(value: object) -> dict:
    """Notes as a mapping: as they are, parsed, or under `raw`."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            pass
        return value if isinstance(value, dict) else {"raw": value}
    return dict(value) if isinstance(value, Mapping) else {}


_QUOTED = re.compile(r'"[^"\n]*"')


def repaired_yaml(source: str) -> str:
    """Backslashes inside double quotes doubled, as patterns written without escapes need."""
    return _QUOTED.sub(lambda m: m[0].replace("\\", "\\\\"), source)


def read_pack(source: str, kind: str) -> object:
    """A configuration pack: json, or yaml, which is repaired where it does not parse."""
    if kind == "json":
        return json.loads(source)
    import yaml

    try:
        return yaml.safe_load(source)
    except yaml.YAMLError:
        return yaml.safe_load(repaired_yaml(source))


#: Names under which a parse service gives what an upload needs.
UPLOAD_LISTS, UPLOAD_URLS = ("file_urls", "fileUrls", "files"), ("url", "upload_url", "uploadUrl", "presigned_url", "presignedUrl", "put_url", "putUrl")
BATCH_IDS = ("batch_id", "batchId", "id")


def upload_target(answer: object) -> tuple[str, str]:
    """(batch id, URL to upload to) in a parse service's answer: the first listed file's, else the answer's own."""
    data = answer.get("data") if isinstance(answer, Mapping) else None
    if not isinstance(data, Mapping):
        return "", ""
    items = [item for name in UPLOAD_LISTS if isinstance(data.get(name), list) for item in data[name]]
    urls = [first_said(*(item.get(k) for k in UPLOAD_URLS)) if isinstance(item, Mapping) else said(item) if isinstance(item, str) else "" for item in (*items, data)]
    return first_said(*(data.get(k) for k in BATCH_IDS)), first_said(*urls)
