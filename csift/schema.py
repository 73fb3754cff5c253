"""Schemas of the relations."""

from __future__ import annotations

_SETS = ", ".join(f"{x}:array<string>" for x in ("reads", "writes", "null_writes", "freed", "allocated", "derefs", "asserted"))
VARIABLE = "struct<name:string,type:string,is_pointer:boolean,is_signed:boolean,is_volatile:boolean,is_vla:boolean,is_array:boolean,has_initializer:boolean,array_size:string,line:int,assigned:array<int>,is_static:boolean>"
PARAMETER = "struct<pos:int,name:string,type:string,is_pointer:boolean,line:int>"
CALL = "struct<idx:int,callee:string,line:int,raw_args:string,args:array<string>,target:string,after_else:array<int>>"
FUNCTION = (
    f"struct<idx:int,name:string,return_type:string,start_line:int,end_line:int,brace_line:int,body_lines:int,empty_params:boolean,void_params:boolean,returns_boolean:boolean,has_assertions:boolean,"
    f"params:array<{PARAMETER}>,variables:array<{VARIABLE}>,calls:array<{CALL}>,words:array<string>,events:array<struct<kind:string,line:int,reads:array<string>>>,"
    f"casts:array<struct<line:int,type:string,is_pointer:boolean,is_function_pointer:boolean,names:array<string>>>,sizeofs:array<struct<line:int,name:string>>,types:map<string,string>>"
)
PARSE = (
    f"struct<status:string,reason:string,parse_tier:string,confidence:string,unsigned_typedefs:array<string>,functions:array<{FUNCTION}>,globals:array<{VARIABLE}>,"
    f"switches:array<struct<line:int,column:int,has_default:boolean>>,controls:array<struct<keyword:string,line:int,column:int,has_brace:boolean>>,"
    f"hits:array<struct<rule:int,line:int,column:int,parameters:array<string>,context:array<string>,pass:int>>,"
    f"nodes:array<struct<fn_idx:int,node_id:int,kind:string,line:int,expr:string,{_SETS.replace(', ', ',')}>>,"
    f"edges:array<struct<fn_idx:int,src:int,dst:int,nonnull:array<string>,null:array<string>>>,"
    f"facts:array<struct<fn_idx:int,node_id:int,line:int,kind:string,var:string,nullness:string,init:string,alloc:string>>>"
)
#: What a file row has after parsing; error is null unless its analysis failed.
PARSED = f"path string, content string, clean string, parse {PARSE}, error struct<error_type:string,message:string>"

FINDING_COLUMNS = (
    "rule_id", "rule_name", "impact", "file_path", "line_number", "column_number", "code_snippet", "message", "remediation", "cwe_id", "engine", "fix_type",
    "auto_fix_replacement", "suggested_fix_replacement", "fingerprint", "confidence",
)
FINDING = "rule_id string, rule_name string, impact string, file_path string, line_number int, column_number int, code_snippet string, message string, remediation string, cwe_id string, engine string, fix_type string, auto_fix_replacement string, suggested_fix_replacement string, fingerprint string, confidence string"
