"""Schemas of reports, stacks, query lists and recommendation lists."""

from __future__ import annotations

FRAME = "struct<depth:int,function:string,file:string,fileline:string,dylib:string,address:string,args:string,lib_tag:string,is_crash:boolean,code:string,extra:array<string>>"
_INNER = f"struct<exception:string,message:string,frames:array<{FRAME}>>"
STACK = f"struct<exception:string,message:string,frames:array<{FRAME}>,nested:array<{_INNER}>>"
REPORT = "bug_id long, dup_id string, creation_ts double, label boolean, stacktrace string, short_desc string, description string"
QUERY = "chunk string, query_ord int, bug_id long, is_duplicate boolean"
RECOMMENDATION = "query_id long, rec_rank int, cand_id long, score double"
