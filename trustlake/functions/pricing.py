"""Money bands, exposure and ceilings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import (
    BANDS,
    NON_EXECUTING_ACTIONS,
    OVER_LIMIT,
    SETTINGS,
    UNPRICED,
    action_table,
)


TERM_COLUMNS = (
    "has_amount", "base_amount", "reversibility", "reversibility_field",
    "visibility", "visibility_field", "blast_radius", "blast_field",
)


def band_of(amount: Column) -> Column:
    """Band name; bounds are upper-exclusive, the top band is closed.

    Above the top the label is ``over_limit``; a negative amount has no band (NULL).
    """
    top_name, _, top = BANDS[-1]
    expr = F.when(amount.isNull() | (amount < 0), F.lit(None).cast("string"))
    for name, _, high in BANDS:
        expr = expr.when(amount < high, F.lit(name))
    return expr.when(amount == top, F.lit(top_name)).otherwise(F.lit(OVER_LIMIT))


def band_label(amount: Column, action: Column, hard_limit: Column | None = None) -> Column:
    """Band as stored on a decision: non-executing actions are ``unpriced``."""
    label = F.when(action.isin(*NON_EXECUTING_ACTIONS), F.lit(UNPRICED))
    if hard_limit is not None:
        label = label.when(amount > hard_limit, F.lit(OVER_LIMIT))
    return label.otherwise(band_of(amount))


def band_index(band: Column) -> Column:
    expr = F.lit(None).cast("int")
    for i, (name, _, _) in enumerate(BANDS):
        expr = F.when(band == name, F.lit(i)).otherwise(expr)
    return expr


def band_max(band: Column) -> Column:
    """Upper end of a priced band, NULL for ``over_limit`` and ``unpriced``."""
    expr = F.lit(None).cast("double")
    for name, _, high in BANDS:
        expr = F.when(band == name, F.lit(high)).otherwise(expr)
    return expr


def _multiplier(name: str, field: str, payload: Column | None) -> Column:
    if payload is None:
        return F.col(name)
    named = F.try_element_at(payload, F.col(field)).cast("double")
    return F.when(F.col(field).isNull(), F.col(name)).otherwise(named)


def multipliers(payload: Column | None = None) -> Column:
    """Product of the three multipliers; NULL when a named payload field is missing."""
    return (
        _multiplier("reversibility", "reversibility_field", payload)
        * _multiplier("visibility", "visibility_field", payload)
        * _multiplier("blast_radius", "blast_field", payload)
    )


def with_action_terms(df: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Attach the risk surface of the action; unregistered actions get NULLs.

    The built-in table is broadcast; how a caller's table travels is left to the planner, which knows its size.
    """
    dim = actions if actions is not None else F.broadcast(action_table(df.sparkSession))
    return df.join(dim, "action", "left")


def exposure(amount: Column, payload: Column | None = None) -> Column:
    """(amount, or the base amount of amount-less actions) times the multipliers."""
    return F.when(F.col("has_amount"), amount).otherwise(F.col("base_amount")) * multipliers(payload)


def ceiling(band: Column, payload: Column | None = None) -> Column:
    """Largest loss the business accepts for the band at proven reliability."""
    return F.lit(SETTINGS.risk_appetite) * band_max(band) * multipliers(payload)
