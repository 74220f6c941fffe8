"""Declared schemas of the records that the pipelines read and write. Optional keys are nullable columns."""

from __future__ import annotations

USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint>"
TEST = "struct<input:string,output:string,testtype:string>"

PROBLEMS = "task_id string, instruct_prompt string, complete_prompt string, canonical_solution string, test string"
QUESTIONS = "task_id string, corrupted_solution string, prompt string, canonical_solution string, test_code string, mutation_types array<string>"
SOLUTIONS = f"task_id string, solution string, llm_response string, llm_reasoning string, corrupted_solution string, prompt string, canonical_solution string, test_code string, token_usage {USAGE}"
VERDICTS = "completion_id int, task_id string, identifier string, solution string, status string, details map<string,string>, test_stats struct<tests_run:int,failures:int,errors:int,skipped:int,was_successful:boolean>"
GENERATION_PROBLEMS = f"question_title string, question_content string, platform string, question_id string, contest_id string, contest_date timestamp, starter_code string, difficulty string, public_test_cases array<{TEST}>, private_test_cases array<{TEST}>, metadata map<string,string>"
EXECUTION_PROBLEMS = "question_id string, contest_id string, contest_date timestamp, difficulty string, function_name string, code string, input string, output string, id string, problem_id string, numsteps int"
TEST_OUTPUT_PROBLEMS = f"question_title string, question_content string, question_id string, contest_id string, contest_date timestamp, difficulty string, test array<{TEST}>, starter_code string, function_name string, test_id int"
EDITS = "problem_spec string, correct_answer string, corrupted_answer string, tests string, applied_mutations array<string>"
SYNTHETIC = "problem_spec string, corrupted_answer string, completion string, canonical_solution string, extracted_completion string, levenshtein int"
CHAT = "conversations array<struct<`from`:string,content:string>>, system string"
PREFERENCE = "instruction string, input string, chosen string, rejected string"

PLATFORMS = ("leetcode", "codeforces", "atcoder")
DIFFICULTIES = ("easy", "medium", "hard")
TEST_TYPES = ("stdin", "functional")
