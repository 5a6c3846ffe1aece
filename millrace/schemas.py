"""Schemas of the records. Readers take these; nothing is inferred from data."""

EVIDENCE = "array<struct<evidence_id:string,index:int,text:string>>"
MESSAGES = "array<struct<role:string,content:string,evidence_index:int,tool_ok:boolean,tool_name:string,error:string,windowed:boolean,system_prompt_version:string>>"
SEGMENTS = "array<struct<text:string,trainable:boolean,role:string,kind:string>>"

ARTICLE = "title string, url string, raw_text string, facts array<string>"
TASK = f"task_id string, kind string, origin string, split string, prompt_variant string, source_id string, hypothesis string, label string, claim string, broken string, gold_url string, n_units int, evidence {EVIDENCE}"
RUN = f"run_id string, task_id string, sample_idx int, teacher string, model string, temperature double, started_at double, wall_s double, steps int, requests int, tokens struct<prompt:bigint,completion:bigint,total:bigint>, cost_usd double, exit string, answer string, cite array<int>, n_lookups int, messages {MESSAGES}, trajectory_hash string"
LEDGER = "ts double, run_id string, task_id string, teacher string, model string, attempt int, prompt_tokens bigint, completion_tokens bigint, tokens bigint, cost_usd double, latency_s double, error string"
VERDICT = "run_id string, task_id string, sample_idx int, reason_code string, detail map<string,string>, predicted string, gold string, variant string, steps int, requests int, tokens bigint, trajectory_hash string"
RESULT = "result_id string, contender string, seed int, task_id string, run_id string, variant string, kind string, passed boolean, label_correct boolean, reason_code string, valid_tool_call boolean, retrieved boolean, steps int, latency_s double, cost_usd double, tokens bigint"
