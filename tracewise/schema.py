"""Chain data model as Spark schemas.

Nested form: one row per chain (``CHAIN``).  Long form: one row per step
(``STEPS``), plus edge and node tables; ``tracewise.operators.convert.to_long``
bridges the two.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Enums of the reference.
DOMAINS = ["math", "code", "medical"]
ERROR_TYPES = ["factual", "logical", "syntax", "unknown"]
HALLUCINATION_TYPES = ERROR_TYPES + ["consistency", "grounding"]

STEP = T.StructType([
    T.StructField("step_id", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("is_origin", T.BooleanType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("depends_on", T.ArrayType(T.IntegerType())),
])
STEP_FIELDS = [f.name for f in STEP.fields]

GRAPH = T.StructType([
    T.StructField("nodes", T.ArrayType(T.IntegerType())),
    T.StructField("edges", T.ArrayType(T.ArrayType(T.IntegerType()))),
])

CHAIN = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("reasoning_steps", T.ArrayType(STEP)),
    T.StructField("dependency_graph", GRAPH),
])

CHAIN_WITH_MODEL = T.StructType(CHAIN.fields + [T.StructField("model_type", T.StringType())])

STEPS = T.StructType([
    T.StructField("chain_id", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("domain", T.StringType()),
] + STEP.fields)

MATH_RAW = T.StructType([
    T.StructField("question", T.StructType([
        T.StructField("problem", T.StringType()),
        T.StructField("ground_truth_answer", T.StringType()),
        T.StructField("pre_generated_steps", T.ArrayType(T.StringType())),
    ])),
    T.StructField("label", T.StructType([
        T.StructField("steps", T.ArrayType(T.StructType([
            T.StructField("completions", T.ArrayType(T.StructType([T.StructField("rating", T.IntegerType())]))),
        ]))),
    ])),
])

INFERENCE_LOG = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("reasoning_steps", T.ArrayType(T.StringType())),
    T.StructField("latency", T.DoubleType()),
    T.StructField("tokens_used", T.IntegerType()),
    T.StructField("error", T.StringType()),
])
