"""Entities of the model as Spark types."""

TOKENS = ("input", "output", "reasoning", "cache_read", "cache_write")
TOKEN_STRUCT = "struct<input:double,output:double,reasoning:double,cache_read:double,cache_write:double>"
TIME_STRUCT = "struct<start:double,firstToken:double,firstResponse:double,firstContent:double,completed:double,ttft:double,duration:double,startMissing:boolean>"
SAMPLE = "struct<timestamp:double,tokens:double,estimatedTokens:double,bytes:double,kind:string>"
SCOPE_STRUCT = "struct<source_scope:string,reasons:array<string>,parent:string>"
UPDATE_STRUCT = "struct<instance:string,sequence:double,received_at:double,revision:double,fingerprint:string,seen:array<string>>"
#: States of a session.
ACTIVE = ("busy", "retry")
TERMINAL = ("completed", "failed", "aborted", "cancelled", "stopped")
STATES = (*ACTIVE, "idle", *TERMINAL)

#: What each field of a record adds to its completeness if it is there (a counter or the cost: if above 0).
#: Samples add 2, and 1 each up to 8 of them.
FIELD_WEIGHTS = {"parent_id": 2, "model": 2, "first_token": 1, "completed": 3, "ttft": 1, "duration": 1}
AMOUNT_WEIGHTS = {"input": 1, "output": 1, "reasoning": 1, "cache_read": 1, "cache_write": 1, "cost": 1}
SAMPLES_WEIGHT, MOST_SAMPLES = 2, 8

#: Scopes of evidence, weakest first.
PENDING, USER, EXCLUDED_ITEM, EXCLUDED_SESSION = "pending", "user", "excluded_item", "excluded_session"
