"""Prompt rendering (P1): per-domain templates x provider style, optional
few-shot examples.  Templates are a small fixed dimension table joined by
broadcast; rendering is ``replace`` / ``concat`` per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small

# The reference's system and task prompts, per domain.
SYSTEM_PROMPTS = {
    "math": "You are a helpful mathematical reasoning assistant. \n"
            "Solve the given problem step-by-step, showing your work clearly. \n"
            "Each step should be numbered and should follow logically from the previous ones.",
    "code": "You are an expert programmer and code analyst.\n"
            "Solve the given coding problem by breaking it down into clear, logical steps.\n"
            "Explain your reasoning for each step.",
    "medical": "You are a medical reasoning assistant with expertise in clinical decision-making.\n"
               "Answer the given medical question by reasoning through it step-by-step.\n"
               "Base your reasoning on established medical knowledge.",
}
TASK_PROMPTS = {
    "math": "Problem: {query}\n\nPlease solve this problem step-by-step. Break down your solution into clear, numbered steps.\n\n"
            "Format your response exactly as follows:\nStep 1: [Your first reasoning step]\n"
            "Step 2: [Your second reasoning step]\n...\nFinal Answer: [Your final answer]",
    "code": "Problem: {query}\n\nPlease solve this coding problem by reasoning through it step-by-step.\n\n"
            "Format your response exactly as follows:\nStep 1: [First step of your reasoning]\n"
            "Step 2: [Second step of your reasoning]\n...\nStep N: [Final step and solution]",
    "medical": "Question: {query}\n\nPlease answer this medical question by reasoning through it step-by-step.\n\n"
               "Format your response exactly as follows:\nStep 1: [First reasoning step]\n"
               "Step 2: [Second reasoning step]\n...\nFinal Answer: [Your conclusion]",
}
STYLES = ["openai", "google", "instruct"]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, SYSTEM_PROMPTS[d], TASK_PROMPTS[d]) for d in SYSTEM_PROMPTS],
                                 "domain string, system_prompt string, task_prompt string")


def render(df: DataFrame, templates: DataFrame, style: str, query: str = "query", domain: str = "domain",
           examples: str | None = None, include_system: bool = True) -> DataFrame:
    """(system, user) messages per row.  openai: separate messages;
    google: system + blank line + task in the user message; instruct:
    <|system|> / <|user|> / <|assistant|> markup.  ``examples`` (array of
    struct<query, solution>) become numbered few-shot blocks before the task."""
    t = templates.withColumnRenamed("domain", "_tdomain")
    j = df.join(broadcast_if_small(t), F.col(domain) == F.col("_tdomain"), "left").drop("_tdomain")
    sysp = F.coalesce(F.col("system_prompt"), F.lit("")) if include_system else F.lit("")
    task = F.replace(F.coalesce(F.col("task_prompt"), F.lit("")), F.lit("{query}"), F.col(query))
    if style == "openai":
        system, user = sysp, task
    elif style == "google":
        system, user = F.lit(""), (F.concat(sysp, F.lit("\n\n"), task) if include_system else task)
    elif style == "instruct":
        system = F.lit("")
        user = F.concat(F.lit("<|system|>\n"), sysp, F.lit("\n<|user|>\n"), task, F.lit("\n<|assistant|>\n"))
    else:
        system, user = sysp, task
    if examples:
        ex = F.array_join(F.transform(F.col(examples), lambda e, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(":\nProblem: "), e["query"], F.lit("\nSolution:\n"),
            e["solution"])), "\n\n")
        user = F.concat(ex, F.lit("\n\nNow solve this problem:\n\n"), user)
    return j.withColumn("system", system).withColumn("user", user).drop("system_prompt", "task_prompt")
