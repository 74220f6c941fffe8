"""Model connectors: a plug-in answers a partition's prompts. None that needs the network is built in."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.code import code_of_response
from ..operators.relational import with_responses

MISSING = "Result missing"
RESPONSE = "final_answer string, reasoning string, error string, prompt_tokens long, completion_tokens long, total_tokens long"


class Connector(ABC):
    """Answers prompts one by one; an exception becomes that row's error, so that other rows are kept."""

    @abstractmethod
    def respond(self, prompt: str) -> dict:
        """Keys of RESPONSE, any of them absent."""


class EchoConnector(Connector):
    """Answers with the prompt in a fence: a stand-in for tests."""

    def respond(self, prompt: str) -> dict:
        words = len(prompt.split())
        return {"final_answer": f"```python\n{prompt}\n```", "prompt_tokens": words, "completion_tokens": words, "total_tokens": 2 * words}


class Retrying(Connector):
    """Asks another connector again after a failure, ``tries`` times in all with ``wait`` seconds between; the last failure counts.

    A failure is an exception of one of the kinds ``on``; any other ends the row at once.
    """

    def __init__(self, inner: Connector, tries: int = 3, wait: float = 5.0, on: tuple[type[Exception], ...] = (OSError, TimeoutError)):
        self.inner, self.tries, self.wait, self.on = inner, tries, wait, on

    def respond(self, prompt: str) -> dict:
        for left in range(self.tries - 1, -1, -1):
            try:
                return self.inner.respond(prompt)
            except self.on:
                if not left:
                    raise
                time.sleep(self.wait)
        raise ValueError("a connector must be asked once at least")


def generate(df: DataFrame, connector: Connector, prompt: str = "prompt") -> DataFrame:
    """``df`` with the columns of RESPONSE. Repartition first where prompts differ much in cost."""
    names = [x.split(" ")[0] for x in RESPONSE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame[prompt]:
                try:
                    rows.append(connector.respond(text))
                except Exception as e:  # noqa: BLE001  any failure of a plug-in is the row's error
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            answers = pd.DataFrame(rows, columns=names, index=frame.index)
            for c in names[:3]:
                answers[c] = answers[c].astype(object).where(answers[c].notna(), None)
            for c in names[3:]:
                answers[c] = answers[c].astype("Int64")
            yield pd.concat([frame, answers], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {RESPONSE}")


def usable(responses: DataFrame) -> DataFrame:
    """Without failed and empty answers: they are asked again on the next run."""
    return responses.filter(F.col("error").isNull() & (F.coalesce("final_answer", F.lit("")) != ""))


def result_rows(responses: DataFrame, keep: list[str]) -> DataFrame:
    """What a run writes for its usable answers: ``keep``, the program, the answer, its reasoning and its tokens."""
    tokens = F.struct("prompt_tokens", "completion_tokens", "total_tokens")
    usage = F.when(F.col("total_tokens").isNotNull(), tokens).alias("token_usage")
    return usable(responses).select(*keep, code_of_response("final_answer").alias("solution"), F.col("final_answer").alias("llm_response"), F.col("reasoning").alias("llm_reasoning"), usage)


def batch_requests(prompts: DataFrame, model: str, key: str = "custom_id", system: str = "system", prompt: str = "prompt") -> DataFrame:
    """JSON lines (column value) of a batch job: one request for each prompt, with the effort that the model's name ends in."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    name = F.lit(model)
    body = F.struct(extract.model_base(name, minimal=True).alias("model"), F.array(turn("system", system), turn("user", prompt)).alias("messages"), extract.effort_suffix(name, minimal=True).alias("reasoning_effort"))
    request = F.struct(F.col(key).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return prompts.select(F.to_json(request).alias("value"))


def join_batch(requests: DataFrame, lines: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Requests with response, reasoning, error and tokens of a batch job's output and error lines (column value).

    Lines come in any order; broken ones are skipped, an error takes the place of an answer, and a request
    that neither file has gets the error "Result missing" and an empty answer.
    """
    get = lambda path: F.get_json_object("value", f"$.{path}")
    number = lambda name: get(f"response.body.usage.{name}").cast("long").alias(name)
    content = get("response.body.choices[0].message.content")
    answers = lines.filter(get("custom_id").isNotNull() & content.isNotNull()).select(get("custom_id").alias("custom_id"), content.alias("response"), F.coalesce(get("response.body.choices[0].message.reasoning"), F.lit("")).alias("reasoning"), F.lit(None).cast("string").alias("error"), *[number(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
    if errors is not None:
        failed = errors.filter(get("custom_id").isNotNull()).select(get("custom_id").alias("custom_id"), F.lit("").alias("response"), F.lit("").alias("reasoning"), get("error").alias("error"))
        answers = answers.unionByName(failed, allowMissingColumns=True)
    # of an answer and an error the error counts
    one = answers.groupBy("custom_id").agg(F.max_by(F.struct(*answers.columns[1:]), F.struct(F.col("error").isNotNull(), "response")).alias("a"))
    joined = requests.join(one, "custom_id", "left")
    missing = F.col("a").isNull()
    shown = joined.select(*requests.columns, F.coalesce("a.response", F.lit("")).alias("response"), F.coalesce("a.reasoning", F.lit("")).alias("reasoning"), F.when(missing, F.lit(MISSING)).otherwise(F.col("a.error")).alias("error"), *[F.col(f"a.{n}").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
    return shown.withColumn("reasoning_tokens", F.col("total_tokens") - F.col("prompt_tokens") - F.col("completion_tokens"))


def answer_batch(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with the answers of a service that gives (custom_id, response) rows, the greatest of several; the default where one is missing."""
    return with_responses(requests, answers.groupBy("custom_id").agg(F.max("response").alias("response")))
