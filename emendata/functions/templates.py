"""Benchmark prompts by model style, as struct<system, messages>.

A family of prompts (generation, repair, test output, execution) has a few texts, built from a row's columns, and
a table of styles: which text a style uses, its system message, and what stands around it. Models without a
system message get all of it in one string.
"""

from __future__ import annotations

import json
import pkgutil
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code generation.
EXPERT = "You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests."
EXPERT_PLAIN = "You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. Do NOT use system calls like `exit` in the generated program. Ensure that the first code block contains the solution."
DEEPSEEK = "You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you answer questions related to computer science."
WITH_STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters."
WITHOUT_STARTER = "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."
WITHOUT_STARTER_REPAIR = "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows."
YOUR_CODE = "```python\n# YOUR CODE HERE\n```\n\n"
ANSWER_FORMAT = "### Answer: (use the provided format with backticks)\n\n"
# Self repair.
REPAIRER = "You are a helpful programming assistant and an expert Python programmer. You are helping a user write a program to solve a problem. The user has written some code, but it has some errors and is not passing the tests. You will help the user by first giving a concise (at most 2-3 sentences) textual explanation of what is wrong with the code. After you have pointed out what is wrong with the code, you will then generate a fixed version of the program. You must put the entired fixed program within code delimiters only for once."
# Test output prediction.
TESTER = "You are a helpful programming assistant and an expert Python programmer. You are helping a user to write a test case to help to check the correctness of the function. The user has written a input for the testcase. You will calculate the output of the testcase and write the whole assertion statement in the markdown code block with the correct output."
# Code execution.
EXECUTE = 'You are given a Python function and an assertion containing an input to the function. Complete the assertion with a literal (no unsimplified expressions, no function calls) containing the output when executing the provided code on the given input, even if the function is incorrect or incomplete. Do NOT output any extra information. Provide the full assertion with the correct output in [ANSWER] and [/ANSWER] tags, following the examples.\n\n[PYTHON]\ndef repeatNumber(number : int) -> int:\n    return number\nassert repeatNumber(number = 17) == ??\n[/PYTHON]\n[ANSWER]\nassert repeatNumber(number = 17) == 17\n[/ANSWER]\n\n[PYTHON]\ndef addCharacterA(string : str) -> str:\n    return string + "a"\nassert addCharacterA(string = "x9j") == ??\n[/PYTHON]\n[ANSWER]\nassert addCharacterA(string = "x9j") == "x9ja"\n[/ANSWER]\n\n[PYTHON]\n'
EXECUTE_STEPS = 'You are given a Python function and an assertion containing an input to the function. Complete the assertion with a literal (no unsimplified expressions, no function calls) containing the output when executing the provided code on the given input, even if the function is incorrect or incomplete. Do NOT output any extra information. Execute the program step by step before arriving at an answer, and provide the full assertion with the correct output in [ANSWER] and [/ANSWER] tags, following the examples.\n\n[PYTHON]\ndef performOperation(s):\n    s = s + s\n    return "b" + s + "a"\nassert performOperation(s = "hi") == ??\n[/PYTHON]\n[THOUGHT]\nLet\'s execute the code step by step:\n\n1. The function performOperation is defined, which takes a single argument s.\n2. The function is called with the argument "hi", so within the function, s is initially "hi".\n3. Inside the function, s is concatenated with itself, so s becomes "hihi".\n4. The function then returns a new string that starts with "b", followed by the value of s (which is now "hihi"), and ends with "a".\n5. The return value of the function is therefore "bhihia".\n[/THOUGHT]\n[ANSWER]\nassert performOperation(s = "hi") == "bhihia"\n[/ANSWER]\n\n[PYTHON]\n'
# Other texts of the four families.
WITHOUT_STARTER_MAIN = "Implement a function called `main()` which orchastrates the solution by reading inputs from stdin and writing the answer to stdout. Feel free to use additional functions as necessary. Next do NOT forget to call `main` function at the end of the program otherwise you will not be awarded any points."
LEAD_ONLY_PROGRAM = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. You will NOT return anything except for the program.\n\n"
LEAD = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.\n\n"
CODEQWEN = "<|im_start|>system\nYou are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. Wrap your response in ```python and ```. Answer with the code and nothing else.<|im_end|>\n<|im_start|>user"
QWQ = "<|im_start|>system\nYou are a helpful and harmless assistant. You are Qwen developed by Alibaba. You should think step-by-step.<|im_end|>\n<|im_start|>user"
DEEPSEEK_R1 = "<｜begin▁of▁sentence｜>A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> <answer> answer here </answer>.<｜User｜>"
CHAT_END = "<|im_end|>\n<|im_start|>assistant\n"
LEAD_INSTRUCTION = f"### Instruction: {LEAD_ONLY_PROGRAM}"
REPAIRER_DEEPSEEK = "You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you are helping a user correct a error program for code competition. The user has written some code, but it has some errors and is not passing the tests. You will help the user by first giving a concise (at most 2-3 sentences) textual explanation of what is wrong with the code. After you have pointed out what is wrong with the code, you will then generate a fixed version of the entire executable program. You must put the entire fixed executable program within code delimiters."
MAGIC = "You are an exceptionally intelligent coding assistant that consistently delivers accurate and reliable responses to user instructions.\n\n@@ Instruction\n"
WIZARD = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
PHIND = "You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. You will NOT return anything except for the program. You must put the entired fixed program within code delimiters only for once., for example: \n```python \n# YOUR CODE HERE\n```"
REPEAT = "First reason about the code providing a textual explanation of what is wrong with the code and then generate a fixed of the program enclosed code delimiters."
REPAIR_EXAMPLE = f"### Instruction: {REPAIRER}, for example:\n    ```python\n    # YOUR CODE HERE\n    ```"
TESTER_TAGS = "You are a helpful programming assistant and an expert Python programmer. You are helping a user to write a test case to help to check the correctness of the function. The user has written a input for the testcase. You will calculate the output of the testcase and  write out the complete assertion statement between [PYTHON] and [/PYTHON] tags."
FUZZER = "You are an expert at Python programming, code execution, test case generation, and fuzzing."
# Marks around the turns of models whose prompt is one string.
HUMAN, ASSISTANT = "\n\nHuman:", "\n\nAssistant:"
IM_SYSTEM, IM_USER, IM_END = "<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
LLAMA_SYSTEM, LLAMA_USER = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
LLAMA_END = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
LLAMA_DATES = "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"
QWEN_DEFAULT = "You are a helpful assistant."
# The worked examples for models without chat, for problems with starter code and without.
_EXAMPLES = json.loads(pkgutil.get_data(__package__, "worked_examples.json"))
FUNCTION_QUESTION, FUNCTION_STARTER, FUNCTION_ANSWER = (_EXAMPLES[f"FUNCTION_{part}"] for part in ("QUESTION", "STARTER", "ANSWER"))
STDIN_QUESTION, STDIN_ANSWER = (_EXAMPLES[f"STDIN_{part}"] for part in ("QUESTION", "ANSWER"))


@dataclass(frozen=True)
class Style:
    """``text`` names a text of the family; ``trim`` cuts white space off its end or off both ends."""

    name: str
    text: str = "generic"
    system: str | None = None
    before: str = ""
    after: str = ""
    trim: str = ""


def _claude(name: str, system: str, text: str = "generic") -> Style:
    return Style(name, text, before=f"{HUMAN}\n{system}\n\n", after=f"\n{ASSISTANT}", trim="end")


def _llama(name: str, system: str, dates: str = "") -> Style:
    return Style(name, before=f"{LLAMA_SYSTEM}{dates}{system}{LLAMA_USER}", after=LLAMA_END, trim="both")


GENERATION = (
    *[Style(name, system=EXPERT) for name in ("OpenAIChat", "DeepSeekAPI", "TogetherAI", "CohereCommand", "MistralWeb")],
    *[Style(name, system=EXPERT, trim="end") for name in ("Claude3", "Claude3Thinking")],
    *[Style(name, before=f"{EXPERT}\n\n") for name in ("OpenAIReasonPreview", "Grok")],
    Style("OpenAIReason", "main", before=f"{EXPERT}\n\n"),
    _llama("LLaMa3", EXPERT),
    _claude("Claude", EXPERT),
    Style("Gemini", before=f"{EXPERT_PLAIN}\n"),
    Style("GeminiThinking", before=f"{EXPERT}\n"),
    Style("DeepSeekCodeInstruct", "instruction", before=f"{DEEPSEEK}\n\n"),
    Style("CodeQwenInstruct", "plain", before=f"{CODEQWEN}\n\n{LEAD_ONLY_PROGRAM}Question: ", after=CHAT_END),
    Style("QwQ", "plain", before=f"{QWQ}\n\n{LEAD}Question: ", after=CHAT_END),
    Style("DeepSeekR1", "plain", before=f"{DEEPSEEK_R1}{LEAD}Question: ", after="<｜Assistant｜>"),
    Style("Qwen3Instruct", "spaced", before=f"{IM_SYSTEM}{EXPERT}{IM_USER}{LEAD_ONLY_PROGRAM}Question:\n", after=IM_END),
    Style("GenericBase", "base"),
)
REPAIR = (
    Style("OpenAIChat", system=REPAIRER, after=f"\n\n{REPEAT}"),
    Style("MistralWeb", system=REPAIRER),
    Style("Claude3", system=REPAIRER, trim="end"),
    _claude("Claude", REPAIRER),
    _llama("LLaMa3", REPAIRER),
    _llama("DracarysLlama", REPAIRER, LLAMA_DATES),
    *[Style(name, before=f"{REPAIRER}\n") for name in ("Gemini", "StarCoderInstruct")],
    Style("DeepSeekCodeInstruct", "response", before=f"{REPAIRER_DEEPSEEK}\n\n{LEAD_INSTRUCTION}Question:\n"),
    Style("CodeLLaMaInstruct", "bare", before=f"[INST] <<SYS>>\n{REPAIRER}\n<</SYS>>\n\n", after="\n[/INST]"),
    Style("MagiCoder", "magic", before=f"{MAGIC}\n{LEAD_ONLY_PROGRAM}Question:\n"),
    Style("WizardCoder", "wizard", before=f"{WIZARD}\n\n{REPAIR_EXAMPLE}\n"),
    Style("Eurusx", "wizard", before=f"[INST] Write Python code to solve the task:\n{REPAIR_EXAMPLE}\n", after="[/INST]"),
    Style("Phind", "phind", before=f"### System Prompt\n\n{PHIND}\n\n### User Message\n\n"),
    Style("DracarysQwen", "phind", before=f"{IM_SYSTEM}{QWEN_DEFAULT}{IM_USER}{REPAIR_EXAMPLE}\n\n\nQuestion:\n", after=IM_END),
)
TEST_OUTPUT = (
    *[Style(name, system=TESTER) for name in ("OpenAIChat", "MistralWeb")],
    Style("Claude3", system=TESTER, trim="end"),
    _claude("Claude", TESTER),
    _llama("LLaMa3", TESTER),
    _llama("DracarysLlama", TESTER, LLAMA_DATES),
    *[Style(name, before=f"{TESTER}\n") for name in ("Gemini", "StarCoderInstruct", "OC")],
    Style("DeepSeekCodeInstruct", before=f"### Instruction: {TESTER}\n\n", after="### Response:\n\n"),
    Style("CodeLLaMaInstruct", before=f"[INST] <<SYS>>\n{TESTER_TAGS}\n<</SYS>>\n\n### Question\n", after="### Answer\n\n[/INST]"),
    Style("MagiCoder", before=f"{TESTER}\nQuestion:\n", after="@@ Response \n"),
    Style("WizardCoder", before=f"{WIZARD}\n\n### Instruction: {TESTER}\n", after="### Response:\n"),
    Style("Phind", before=f"### System Prompt\n\n{TESTER}\n\n### User Message\n\n", after="\n\n### Assistant"),
    Style("DracarysQwen", before=f"{IM_SYSTEM}{QWEN_DEFAULT}{IM_USER}### Instruction: {TESTER}\n", after=f"### Response:\n{IM_END}"),
)
EXECUTION = (
    *[Style(name, system=FUZZER) for name in ("OpenAIChat", "MistralWeb", "Claude3")],
    _llama("LLaMa3", FUZZER),
    _llama("DracarysLlama", FUZZER, LLAMA_DATES),
    *[Style(name) for name in ("Claude", "Gemini", "StarCoderInstruct", "DeepSeekCodeInstruct", "CodeLLaMaInstruct", "MagiCoder", "WizardCoder", "Phind", "OC", "DracarysQwen")],
)


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _by_style(styles: tuple[Style, ...], texts: dict[str, Column]) -> Column:
    """array<struct<style, prompt>> of all styles of a family."""
    out = []
    for style in styles:
        text = texts[style.text]
        if style.trim:
            text = F.regexp_replace(text, r"\s+\z" if style.trim == "end" else r"\A\s+|\s+\z", "")
        turn = F.struct(F.lit("user").alias("role"), F.concat(F.lit(style.before), text, F.lit(style.after)).alias("content"))
        prompt = F.struct(F.lit(style.system).cast("string").alias("system"), F.array(turn).alias("messages"))
        out.append(F.struct(F.lit(style.name).alias("style"), prompt.alias("prompt")))
    return F.array(*out)


def _asked(content: Column, starter: Column, lead: str, without: str = f"{WITHOUT_STARTER}\n") -> Column:
    """A problem and the format of its answer, which depends on whether there is starter code."""
    shape = F.when(_filled(starter), F.concat(F.lit(f"{lead}{WITH_STARTER}\n```python\n"), starter, F.lit("\n```\n\n"))).otherwise(F.lit(f"{lead}{without}{YOUR_CODE}"))
    return F.concat(content, F.lit("\n\n"), shape)


def question(content: Column, starter: Column, without: str = f"{WITHOUT_STARTER}\n") -> Column:
    """The generic question."""
    return F.concat(F.lit("### Question:\n"), _asked(content, starter, "### Format: ", without), F.lit(ANSWER_FORMAT))


def base_question(content: Column, starter: Column) -> Column:
    """For models without chat: one worked example, chosen by whether there is starter code, then the question."""
    code = F.when(_filled(starter), F.concat(F.lit("### Starter Code\n"), starter, F.lit("\n\n"))).otherwise(F.lit(""))
    function = f"### Question\n{FUNCTION_QUESTION}\n\n### Starter Code\n{FUNCTION_STARTER}\n\n### Answer\n\n{FUNCTION_ANSWER}\n\n"
    stdin = f"### Question\n{STDIN_QUESTION}\n\n### Answer\n\n{STDIN_ANSWER}\n\n"
    return F.concat(F.when(_filled(starter), F.lit(function)).otherwise(F.lit(stdin)), F.lit("### Question\n"), content, F.lit("\n\n"), code, F.lit("### Answer\n\n"))


def generation_prompts(problems: DataFrame) -> DataFrame:
    """(question_id, style, prompt) for each problem and style."""
    content, starter = F.col("question_content"), F.col("starter_code")
    texts = {
        "generic": question(content, starter),
        "main": question(content, starter, f"{WITHOUT_STARTER_MAIN}\n"),
        "instruction": F.concat(F.lit(f"{LEAD_INSTRUCTION}Question:\n"), _asked(content, starter, "### Instruction: "), F.lit("### Response:\n\n")),
        "plain": _asked(content, starter, ""),
        "spaced": _asked(content, starter, "", f"{WITHOUT_STARTER}\n\n"),
        "base": base_question(content, starter),
    }
    return problems.select("question_id", F.inline(_by_style(GENERATION, texts)))


def check_message(metadata: Column) -> Column:
    """What went wrong, from a grader's JSON; empty without a code. Codes that are not known raise an error.

    Codes: -1 compilation, -2 wrong answer, -3 time limit, -4 run time.
    """
    get = lambda name: F.coalesce(F.get_json_object(metadata, f"$.{name}"), F.lit(""))
    code = F.get_json_object(metadata, "$.error_code").cast("int")
    wrong = F.lit("The above code is incorrect and got ")
    return (
        F.when(code.isNull(), F.lit(""))
        .when(code == -1, F.concat(wrong, F.lit("the following compilation error.\n"), get("error")))
        .when(code == -2, F.concat(wrong, F.lit("a wrong answer.\nInput: "), get("inputs"), F.lit("\nGenerated Output: "), get("output"), F.lit("\nExpected: "), get("expected")))
        .when(code == -3, F.concat(wrong, F.lit("time limit exceeded.\n"), get("error"), F.lit("\nInput: "), get("inputs"), F.lit("\nExpected: "), get("expected")))
        .when(code == -4, F.concat(wrong, F.lit("a runtime error.\nInput: "), get("inputs"), F.lit("\nExpected: "), get("expected"), F.lit("\n"), get("error")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown error code in "), metadata)).cast("string"))
    )


def repair_prompts(samples: DataFrame) -> DataFrame:
    """``samples`` with style and prompt: a request for each style to repair ``code`` that failed, from ``metadata``.

    Columns question_content, code, passed and metadata. A sample that passed has an empty request.
    """
    content, code, check = F.col("question_content"), F.col("code"), check_message(F.col("metadata"))
    end = F.lit(f"### Format: {WITHOUT_STARTER_REPAIR}\n{YOUR_CODE}{ANSWER_FORMAT}")

    def text(before: str, between: str, after: str) -> Column:
        return F.concat(F.lit(before), content, F.lit(between), code, F.lit(after), check)

    texts = {
        "generic": F.concat(text("### Question:\n", "\n\n### Answer:\n```python\n", "\n```\n\n"), F.lit("\n"), end),
        "bare": F.concat(text("### Question\n", "\n\n### Answer\n```python\n", "\n```\n\n"), end),
        "response": F.concat(text("", "\n\n### Response:\n```python\n", "\n```\n\n"), end),
        "magic": F.concat(text("", "\n\n@@ Response \n```python\n", "\n```\n\n"), end),
        "wizard": F.concat(text("", "\n\n### Response:```python\n\n", "\n```\n\n"), end),
        "phind": F.concat(text("", "\n\n```python\n", "\n``` \n\n"), F.lit("\n\n### Assistant"), end),
    }
    empty = [F.struct(F.lit(s.name).alias("style"), F.struct(F.lit(None).cast("string").alias("system"), F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content"))).alias("messages")).alias("prompt")) for s in REPAIR]
    return samples.select("*", F.inline(F.when(F.coalesce(F.col("passed"), F.lit(False)), F.array(*empty)).otherwise(_by_style(REPAIR, texts))))


def test_case(function: Column, test_input: Column) -> Column:
    return F.concat(F.lit("assert "), function, F.lit("("), F.replace(test_input, F.lit("\n"), F.lit(", ")), F.lit(") == # TODO"))


def test_output_prompts(problems: DataFrame) -> DataFrame:
    """``problems`` with style and prompt. Columns question_content, starter_code, function_name and test_input."""
    parts = [F.lit("Problem:\n"), F.col("question_content"), F.lit("Function:\n```\n"), F.col("starter_code"), F.lit("\n```\nPlease complete the following test case:\n\n```\n"), test_case(F.col("function_name"), F.col("test_input")), F.lit("\n```\n")]
    return problems.select("*", F.inline(_by_style(TEST_OUTPUT, {"generic": F.concat(*parts)})))


def execution_prompts(problems: DataFrame, steps: bool = False) -> DataFrame:
    """``problems`` with style and prompt: what ``code`` gives for ``call``, at once or step by step."""
    end = "[THOUGHT]\n" if steps else "[ANSWER]\n"
    text = F.concat(F.lit(EXECUTE_STEPS if steps else EXECUTE), F.col("code"), F.lit("\nassert "), F.col("call"), F.lit(f" == ??\n[/PYTHON]\n{end}"))
    return problems.select("*", F.inline(_by_style(EXECUTION, {"generic": text})))
