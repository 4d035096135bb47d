"""Label / code expressions (F5, F9, F14 lookups, X12)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.constants import ASPECT_CODE_TO_LABEL, CONCEPTS, DIRECTIONS, SCORE_ENCODINGS


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def decode_aspect_prediction(col: Column, strict: bool = True) -> Column:
    """an aspect prediction stored as int code, digit text or ``tensor(n)`` text -> label.

    Already-decoded labels pass through. In strict mode an unknown code raises.
    """
    s = col.cast("string")
    digit = F.regexp_extract(s, r"^(?:tensor\()?\s*(-?\d+)\s*\)?$", 1)
    code = F.when(digit != "", digit.try_cast("int"))
    decoded = F.element_at(literal_map(ASPECT_CODE_TO_LABEL), code)
    out = F.when(s.isin(*DIRECTIONS), s).otherwise(decoded)
    if strict:
        out = F.when(col.isNull(), F.lit(None).cast("string")).when(
            out.isNull(), F.raise_error(F.concat(F.lit("unknown aspect prediction code: "), s))
        ).otherwise(out)
    return out


def encode_score(col: Column, dataset_type: str, strict: bool = False) -> Column:
    """review score text -> class int; unknown key is an error in strict mode, else null."""
    code = F.element_at(literal_map(SCORE_ENCODINGS[dataset_type]), col.cast("string"))
    if strict:
        code = F.when(code.isNull(), F.raise_error(F.concat(F.lit("no encoding for score: "), F.coalesce(col.cast("string"), F.lit("null"))))).otherwise(code)
    return code.cast("int")


def concept_value(concept: Column, fmt: str) -> Column:
    """Pick column ``fmt.format(c)`` where c = value of ``concept`` (CASE over the fixed domain)."""
    expr = None
    for c in CONCEPTS:
        expr = (F.when(concept == c, F.col(fmt.format(c))) if expr is None
                else expr.when(concept == c, F.col(fmt.format(c))))
    return expr


def unpivot_concepts(df, id_cols: list[str], fmt: str, value_name: str):
    """One row per (id, concept) from the four dynamic concept columns."""
    pairs = ", ".join(f"'{c}', `{fmt.format(c)}`" for c in CONCEPTS)
    return df.selectExpr(*[f"`{c}`" for c in id_cols], f"stack({len(CONCEPTS)}, {pairs}) as (concept, {value_name})")
