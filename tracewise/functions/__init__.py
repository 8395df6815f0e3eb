"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from tracewise.functions.common import (  # noqa: F401
    safe_div, r6, strip_ws, substr_count, words, WORD_RE, hash_key, PY_WS, PY_NON_WS,
)
