"""Parameter names: categories, layers, optimizer groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values, in order; the first with a part in the name decides. A part with ``$`` has to end it.
CATEGORIES = (
    ("lsq_scale", ("weight_scale",)),
    ("embed", ("tok_embeddings", "embed")),
    ("lm_head", ("lm_head", "output.weight$")),
    ("attn", (".attn.",)),
    ("ffn", (".ffn.", "w_gate", "w_up", "w_down")),
    ("norm", ("norm",)),
)


def category(name: Column, rules=CATEGORIES) -> Column:
    """The diagnostic category of a parameter name."""
    out = F.lit("other")
    for label, parts in reversed(rules):
        has = F.lit(False)
        for p in parts:
            has = has | (F.endswith(name, F.lit(p[:-1])) if p.endswith("$") else F.contains(name, F.lit(p)))
        out = F.when(has, F.lit(label)).otherwise(out)
    return out


def layer_index(name: Column) -> Column:
    """The number behind a ``layers`` or ``blocks`` path part, or null."""
    found = F.regexp_extract(name, r"(?:^|\.)(?:layers|blocks)\.(\d+)(?:\.|$)", 1)
    return F.when(found != "", found.cast("int"))


def no_decay(dims: Column, name: Column, parts: list[str]) -> Column:
    """Below two dimensions, or a name with one of ``parts``."""
    return (dims < 2) | F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(name, p))


def hidden_matrix(dims: Column, name: Column) -> Column:
    """Two-dimensional, and no embedding, output or norm."""
    return (dims == 2) & ~F.exists(F.array(F.lit("tok_embeddings"), F.lit("output"), F.lit("norm")), lambda p: F.contains(name, p))
