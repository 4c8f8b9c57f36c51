"""Wilson bounds, earned budget and evidence weights as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake.config import DAY_US, EVIDENCE_WEIGHTS, SENSOR_STACK, SETTINGS


def wilson(clean: Column, total: Column, z: float = SETTINGS.z) -> tuple[Column, Column]:
    """(lower, upper) of the Wilson interval; both 0 when there is nothing to count."""
    n = F.when(total > 0, total.cast("double"))
    rate = clean / n
    spread = F.lit(z) * F.sqrt(rate * (1 - rate) / n + F.lit(z * z) / (4 * n * n))
    centre = rate + F.lit(z * z) / (2 * n)
    scale = 1 + F.lit(z * z) / n
    low = F.greatest(F.lit(0.0), (centre - spread) / scale)
    high = F.least(F.lit(1.0), (centre + spread) / scale)
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0))


def wilson_lower(clean: Column, total: Column) -> Column:
    return wilson(clean, total)[0]


def budget(p_lo: Column, ceiling: Column, n_own_raw: Column) -> Column:
    """Share of the ceiling earned above ``p_min``; nothing below the sample floor."""
    earned = ceiling * (p_lo - SETTINGS.p_min) / (1.0 - SETTINGS.p_min)
    return F.when(n_own_raw < SETTINGS.min_own_observations, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(ceiling, earned))
    )


def source_weight(source: Column) -> Column:
    """Weight of an outcome source; an unregistered source weighs nothing."""
    expr = F.lit(0.0)
    for name, weight in EVIDENCE_WEIGHTS.items():
        expr = F.when(source == name, F.lit(weight)).otherwise(expr)
    return expr


def age_weight(as_of_us: Column | int, observed_us: Column) -> Column:
    """Half-life decay of evidence; evidence from the future counts as age zero."""
    as_of = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    age = F.greatest(F.lit(0), as_of - observed_us)
    return F.pow(F.lit(0.5), age / F.lit(float(SETTINGS.age_halflife_days * DAY_US)))


def observed_at(outcome_us: Column, ts_us: Column) -> Column:
    """Outcome time, or the decision time where none (or zero) is stored."""
    return F.when(outcome_us.isNull() | (outcome_us == 0), ts_us).otherwise(outcome_us)


def evidence_age_weight(source: Column, outcome_us: Column, ts_us: Column, as_of_us: Column | int) -> Column:
    return source_weight(source) * age_weight(as_of_us, observed_at(outcome_us, ts_us))


def platt(p: Column, a: Column | float, b: Column | float) -> Column:
    """Platt scaling on the logit of a probability kept away from 0 and 1."""
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    a = F.lit(a) if isinstance(a, (int, float)) else a
    b = F.lit(b) if isinstance(b, (int, float)) else b
    return 1 / (1 + F.exp(-(a * F.ln(clipped / (1 - clipped)) + b)))


# fixed values: the short escapes of JSON strings, by code point
SHORT_ESCAPES = {34: '\\"', 92: "\\\\", 8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _quoted(text: Column) -> Column:
    """JSON string literal in ASCII: control characters and all beyond ASCII as \\uXXXX, pairs beyond U+FFFF."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        beyond = code - 0x10000
        out = F.when(code.between(32, 126) & ~code.isin(34, 92), c)
        for short, text_of in SHORT_ESCAPES.items():
            out = out.when(code == short, F.lit(text_of))
        out = out.when(code < 0x10000, unit(code))
        return out.otherwise(F.concat(unit(0xD800 + F.shiftright(beyond, 10)), unit(0xDC00 + beyond.bitwiseAND(0x3FF))))

    plain = ~text.rlike(r'[^ !#-\[\]-~]')
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == "", c).otherwise(escaped(c))), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(spelled), F.lit('"'))


def fingerprint(model: Column, prompt: Column, tools: Column, sensors: Column, calibrator: Column) -> Column:
    """Identity of a configuration: 16 hex digits over the canonical JSON of its parts.

    ``tools`` is an array of ``struct<name, json>`` where ``json`` is the tool's
    schema in canonical form (sorted keys, no blanks). The prompt enters by hash.
    """
    ordered = F.array_join(F.transform(F.array_sort(tools), lambda t: t["json"]), ",")
    text = F.concat(
        F.lit('{"calibrator":'), _quoted(calibrator),
        F.lit(',"model":'), _quoted(model),
        F.lit(',"prompt":"'), F.sha2(prompt, 256),
        F.lit('","sensors":'), _quoted(sensors),
        F.lit(',"tools":['), ordered, F.lit("]}"),
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def sensor_version(stack: dict[str, str] = SENSOR_STACK) -> str:
    """Version label of the sensor stack; a configuration constant, not a column."""
    canonical = json.dumps(stack, sort_keys=True, separators=(",", ":"))
    return "sv-" + hashlib.sha256(canonical.encode()).hexdigest()[:12]


def sensor_version_column(tier0: Column, tier1: Column, model: Column, thinking: Column) -> Column:
    """The same label for stacks that are stored as rows."""
    text = F.concat(
        F.lit('{"tier0":'), _quoted(tier0), F.lit(',"tier1":'), _quoted(tier1),
        F.lit(',"tier2_model":'), _quoted(model), F.lit(',"tier2_thinking":'), _quoted(thinking), F.lit("}"),
    )
    return F.concat(F.lit("sv-"), F.substring(F.sha2(text, 256), 1, 12))
