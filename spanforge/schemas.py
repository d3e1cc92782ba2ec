"""Schemas of the tables that operators exchange."""

from __future__ import annotations

CATEGORIES = ("PERSON", "EMAIL", "PHONE", "COMPANY", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP")

SPAN = "struct<text:string,start:int,end:int>"
MATCH = "struct<text:string,category:string,start:int,end:int,confidence:double,needs_review:boolean,detector:string,seq:int>"
RUN = "struct<idx:int,text:string,start:int,attrs:map<string,string>>"
LOCATION = "struct<type:string,para_idx:int,table_idx:int,row_idx:int,col_idx:int,section_idx:int>"

BLOCKS = f"doc_id string, block_seq int, text string, location {LOCATION}, runs array<{RUN}>"
MATCHES = "text string, category string, start_char int, end_char int, confidence double, needs_review boolean, detector string"
TRUTH = "doc_id string, text string, category string, para_idx int, start_char int, end_char int, notes string, id string"
DETECTIONS = f"doc_id string, text string, category string, start_char int, end_char int, source_location struct<type:string,para_idx:int,table_idx:int,row_idx:int,col_idx:int,section_idx:int,run_offsets:array<int>>, confidence double, needs_review boolean, detector string"
