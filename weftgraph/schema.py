"""Declared schemas: nothing is inferred on read."""

from __future__ import annotations

SKIPPED = "file string, line int, reason string, expr string, names array<string>, method string"
OBJECTS = (
    "id string, object_type string, slug string, name string, summary string, version string, source string, "
    "generation_strategy string, last_generated_at timestamp, payload string"
)
EDGES = (
    "from_id string, relationship string, to_id string, source string, confidence string, via_paths array<string>, via_hosts array<string>, "
    "via_config_keys array<string>, channels array<string>, weight int, matched array<string>, status string"
)
ENRICHMENTS = "object_id string, object_type string, model string, dim int, summary string, content_hash string, vector array<float>"
META = "key string, value string"
PAYLOADS = {
    "service": (
        "symbol_count int, interface_count int, outbound array<struct<verb:string,path:string,host:string,evidence:string>>, "
        "host_bindings array<struct<key:string,host:string,port:string,value:string,file:string>>, declared_hosts map<string,string>, "
        f"identity struct<port:string,name:string>, root string, skipped array<struct<file:string,line:int,reason:string,expr:string,names:array<string>,method:string>>, "
        "dependencies array<string>, language string, languages array<string>, purpose array<string>"
    ),
    "library": "symbol_count int, root string",
    "interface": "type string, method string, path string, handler string, framework string, evidence array<string>, confidence string, gap string",
    "code_symbol": "path string, qualname string, kind string, lang string, line_start int, line_end int, file_sha string",
    "guidance": (
        "status string, scope string, applies_to struct<dependencies:array<string>,languages:array<string>>, forbids map<string,array<string>>, "
        "reviewed date, owner string, file string, root string, content_hash string"
    ),
    "relationship_stub": "stub boolean, reason string",
}
CALL_GRAPH = "nodes array<struct<id:string,path:string,qualname:string,kind:string,lang:string,line_start:int,line_end:int>>, edges array<struct<`from`:string,`to`:string,weight:int>>"
