"""Schemas of the JSON Lines files; reading never infers one."""

QA = "id string, question string, answer string, supporting_facts array<struct<title:string,sent_id:int,paragraph_text:string>>, dataset string, split string"
HOTPOTQA = "id string, question string, answer string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"
MUSIQUE = "id string, question string, answer string, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>"
TWOWIKI = "_id string, id string, question string, answer string, supporting_facts string"
PASSAGES = "id string, title string, text string"
TRAJECTORIES = "id string, question_id string, question string, text string, search_records array<struct<query:string,num_results:int,doc_ids:array<string>>>, num_search_steps int, num_tokens int, generation_time_s double, incomplete boolean, no_search_after_retries boolean, trajectory_idx int, retry_count int, dataset string"
