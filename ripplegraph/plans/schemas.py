"""JSON Schemas of the documents; additional properties are refused."""

from __future__ import annotations

DRAFT = "https://json-schema.org/draft/2020-12/schema"
TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}


def listed(items: dict) -> dict:
    return {"type": "array", "items": items}


def record(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": {**required, **(optional or {})}}


SPAN = record({"file": TEXT, "start_line": NUMBER, "start_col": NUMBER, "end_line": NUMBER, "end_col": NUMBER})
ENDPOINT = record({"method": TEXT, "path": TEXT})
SUMMARY_ENDPOINT = record({"method": TEXT, "path": TEXT, "routes": listed(ENDPOINT)})
NODE = record(
    {"id": TEXT, "kind": TEXT, "level": NUMBER, "children": listed({"$ref": "#/$defs/node"})},
    {"name": TEXT, "file": TEXT, "package": TEXT, "relation": TEXT, "raw": TEXT, "cycle": FLAG, "method": TEXT, "path": TEXT},
)
FILE_SOURCE = record({"sourceFile": TEXT, "symbols": {"type": "object", "additionalProperties": {"$ref": "#/$defs/node"}}, "impactedEndpoints": listed(SUMMARY_ENDPOINT), "impactedIMEvents": listed(TEXT)}, {"diff": TEXT})
REPLACEMENT = record({"path": TEXT}, {"version": TEXT})
MODULE_SOURCE = record({"modulePath": TEXT, "changeType": {"enum": ["added", "removed", "upgraded", "downgraded", "replaced"]}, "basis": {"enum": ["precise", "file_fallback", "unreferenced"]}}, {"versionBefore": TEXT, "versionAfter": TEXT, "replacementBefore": REPLACEMENT, "replacementAfter": REPLACEMENT, "sourceFiles": listed(FILE_SOURCE)})
ROOT = record({"id": TEXT, "kind": TEXT}, {"name": TEXT, "file": TEXT})
END_SOURCE = record({"sourceType": {"enum": ["file", "module"]}, "rootSymbols": listed(ROOT), "chains": listed(listed(TEXT))}, {"sourceFile": TEXT, "modulePath": TEXT, "changeType": TEXT, "versionBefore": TEXT, "versionAfter": TEXT})
CONTRACT_FIELDS = {"id": TEXT, "kind": {"enum": ["grpc", "dubbo", "http", "job"]}, "identity": TEXT, "identityResolution": {"enum": ["exact", "symbolic"]}}
CONTRACT = record(CONTRACT_FIELDS)


def by_protocol(items: dict) -> dict:
    return record({k: listed(items) for k in ("grpc", "dubbo", "http", "job")})


FACT = {"id": TEXT}
SCHEMAS = {
    "facts": {"$schema": DRAFT}
    | record({
        "project": record({"root": TEXT, "module_path": TEXT}),
        "symbols": listed(record({**FACT, "kind": {"enum": ["func", "method", "type", "var", "const"]}, "package_path": TEXT, "name": TEXT, "span": SPAN}, {"receiver": TEXT})),
        "references": listed(record({**FACT, "kind": {"enum": ["call", "type", "value"]}, "from_symbol": TEXT, "to_symbol": TEXT, "to_raw": TEXT, "span": SPAN, "evidence": listed(record({"kind": TEXT, "raw": TEXT, "span": SPAN}))})),
        "annotations": listed(record({**FACT, "method": TEXT, "path": TEXT, "raw": TEXT, "handler_symbol": TEXT, "span": SPAN})),
        "route_groups": listed(record({**FACT, "group_var": TEXT, "prefix": TEXT, "route_func": TEXT, "statement_index": NUMBER, "span": SPAN}, {"parent_group_id": TEXT})),
        "routes": listed(record({**FACT, "method": TEXT, "group_id": TEXT, "handler_raw": TEXT, "wrappers": listed(record({"name": TEXT, "raw": TEXT, "guessed": FLAG})), "route_func": TEXT, "statement_index": NUMBER, "span": SPAN}, {"local_path": TEXT, "path_raw": TEXT, "resolved_path": TEXT, "handler_symbol": TEXT})),
        "middleware": listed(record({**FACT, "group_id": TEXT, "middleware_raw": TEXT, "middleware_symbols": listed(TEXT), "route_func": TEXT, "statement_index": NUMBER, "span": SPAN})),
        "im_events": listed(record({**FACT, "event_raw": TEXT, "sender_symbol": TEXT, "resolved": FLAG, "evidence": listed(SPAN)}, {"event": TEXT})),
        "grpc_operations": listed(record({**FACT, "source": {"enum": ["client", "server"]}, "symbols": listed(TEXT)})),
        "modules": listed(record({"module": TEXT, "version": TEXT, "indirect": FLAG}, {"replace_path": TEXT, "replace_version": TEXT})),
        "diagnostics": listed(record({"code": TEXT, "severity": TEXT, "message": TEXT, "file": TEXT})),
    }),
    "impact": {"$schema": DRAFT, "$defs": {"node": NODE}}
    | record({
        "summary": record({"impactedEndpointCount": NUMBER, "impactedEndpoints": listed(SUMMARY_ENDPOINT), "impactedIMCount": NUMBER, "impactedIMEvents": listed(TEXT)}),
        "fileSources": listed(FILE_SOURCE),
        "grpcSources": listed(record({"grpc": record({"identity": TEXT, "goMethod": TEXT}), "impactedEndpoints": listed(ENDPOINT)})),
        "endpointSourcesSummary": listed(record({"method": TEXT, "path": TEXT, "sources": listed(END_SOURCE)})),
    }, {"moduleSources": listed(MODULE_SOURCE)}),
    "grpc-impact": {"$schema": DRAFT}
    | record({
        "summary": by_protocol(CONTRACT),
        "fileSources": listed(record({"sourceFile": TEXT, "roots": listed(TEXT), "impactedContracts": by_protocol(CONTRACT)})),
        "entrySourcesSummary": by_protocol(record({**CONTRACT_FIELDS, "sources": listed(record({"sourceType": TEXT, "sourceFile": TEXT, "roots": listed(record({"id": TEXT, "level": NUMBER}))}, {"modulePath": TEXT}))})),
    }, {"moduleSources": listed(record({"modulePath": TEXT, "changeType": TEXT, "impactedContracts": by_protocol(CONTRACT)}))}),
    "endpoint-assets": {"$schema": DRAFT} | record({"endpoints": listed(record({"method": TEXT, "path": TEXT, "operations": listed(TEXT)}))}),
}


def violations(value, schema: dict, top: dict | None = None, at: str = "$") -> list[str]:
    """Where a document departs from its schema (of the keywords used above)."""
    top = top or schema
    if ref := schema.get("$ref"):
        return violations(value, top["$defs"][ref.rsplit("/", 1)[-1]], top, at)
    if "enum" in schema:
        return [] if value in schema["enum"] else [f"{at}: {value!r}"]
    kinds = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}
    if not isinstance(value, kinds[schema["type"]]) or schema["type"] == "integer" and isinstance(value, bool):
        return [f"{at}: not of type {schema['type']}"]
    if schema["type"] == "array":
        return [v for i, x in enumerate(value) for v in violations(x, schema["items"], top, f"{at}[{i}]")]
    if schema["type"] == "object":
        known, more = schema.get("properties", {}), schema.get("additionalProperties")
        out = [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += violations(x, known[k], top, f"{at}.{k}")
            elif isinstance(more, dict):
                out += violations(x, more, top, f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
        return out
    return []
