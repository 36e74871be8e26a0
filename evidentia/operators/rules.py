"""Call rules over the fact table: each is a predicate on calls (module, fn, arity, shape, head, safe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls as module.function/arity, and the functions that evaluate code.
ATOM_CALLS = ("String.to_atom/1", "List.to_atom/1", "Module.concat/1", "Module.concat/2", "erlang.list_to_atom/1", "erlang.binary_to_atom/2")
EXEC_CALLS = ("os.cmd/1", "os.cmd/2", "System.shell/1", "System.shell/2")
PORT_CALL, PORT_HEADS = "erlang.open_port/2", ("spawn", "spawn_executable")
TERM_CALLS = ("erlang.binary_to_term/1", "erlang.binary_to_term/2")
EVAL_FUNCTIONS = {"Code": ("eval_file", "eval_quoted", "eval_string"), "EEx": ("eval_file", "eval_string")}


def _mfa() -> Column:
    return F.concat("module", F.lit("."), "fn", F.lit("/"), F.col("arity").cast("string"))


def calls_to(calls: DataFrame, module: str, fn: str | None = None) -> DataFrame:
    """Calls of a module, or of one function of it."""
    of = calls.where(F.col("module") == module)
    return of if fn is None else of.where(F.col("fn") == fn)


def unsafe_atom(calls: DataFrame) -> DataFrame:
    """Atoms made of dynamic input."""
    return calls.where(_mfa().isin(*ATOM_CALLS) & (F.col("shape") == "dynamic"))


def unsafe_exec(calls: DataFrame) -> DataFrame:
    """Shell commands and spawned ports; of medium confidence with dynamic input, else low."""
    spawned = (_mfa() == PORT_CALL) & F.col("head").isin(*PORT_HEADS)
    return calls.where(_mfa().isin(*EXEC_CALLS) | spawned).withColumn("confidence", F.when(F.col("shape") == "dynamic", "medium").otherwise("low"))


def deserialization(calls: DataFrame) -> DataFrame:
    """Terms read from bytes; a safe option qualifies the match and does not hide it."""
    return calls.where(_mfa().isin(*TERM_CALLS)).withColumn("qualification", F.when((F.col("arity") == 2) & F.col("safe"), "safe_option").otherwise("none"))


def dynamic_code(calls: DataFrame) -> DataFrame:
    """Evaluated code, with its input's shape."""
    found = F.lit(False)
    for module, names in EVAL_FUNCTIONS.items():
        found = found | ((F.col("module") == module) & F.col("fn").isin(*names))
    return calls.where(found)


def classify_api(calls: DataFrame, table: DataFrame) -> DataFrame:
    """calls with each behaviour of their exact (module, fn) in a table (module, fn, behavior); calls without one are left out."""
    return calls.join(table.distinct(), ["module", "fn"])
