"""SQL text pieces for the checks: the formulas of the ledger and the gate, spelled out in SQL."""

from __future__ import annotations

from trustlake.config import BANDS, EVIDENCE_WEIGHTS, SETTINGS


def d(value: float) -> str:
    """A double literal (plain decimals would be typed DECIMAL)."""
    return f"'{float(value)!r}'::double"


def wilson_parts(clean: str, total: str) -> tuple[str, str]:
    z, zz = d(SETTINGS.z), d(SETTINGS.z * SETTINGS.z)
    n = f"cast({total} as double)"
    r = f"({clean} / {n})"
    spread = f"({z} * sqrt({r} * (1 - {r}) / {n} + {zz} / (4 * {n} * {n})))"
    centre = f"({r} + {zz} / (2 * {n}))"
    scale = f"(1 + {zz} / {n})"
    low = f"case when {total} > 0 then greatest({d(0)}, ({centre} - {spread}) / {scale}) else {d(0)} end"
    high = f"case when {total} > 0 then least({d(1)}, ({centre} + {spread}) / {scale}) else {d(0)} end"
    return low, high


def wilson_low(clean: str, total: str) -> str:
    return wilson_parts(clean, total)[0]


def budget(p_lo: str, ceiling: str, raw: str) -> str:
    earned = f"{ceiling} * ({p_lo} - {d(SETTINGS.p_min)}) / {d(1 - SETTINGS.p_min)}"
    return f"case when {raw} < 30 then {d(0)} else greatest({d(0)}, least({ceiling}, {earned})) end"


def mult(action: str, recipients: str = "null") -> str:
    return (
        f"case {action} when 'issue_refund' then {d(0.3)}*{d(1.2)}*{d(1)} "
        f"when 'send_bulk_email' then {d(0.95)}*{d(2)}*cast({recipients} as double) end"
    )


def exposure(action: str, amount: str, recipients: str = "null") -> str:
    return (
        f"case {action} when 'no_action' then {d(0)} when 'escalate' then {d(0)} "
        f"when 'issue_refund' then {amount} * ({mult(action)}) "
        f"when 'send_bulk_email' then {d(500)} * ({mult(action, recipients)}) end"
    )


def band_max(band: str) -> str:
    return f"case {band} " + " ".join(f"when '{n}' then {d(h)}" for n, _, h in BANDS) + " end"


def ceiling(action: str, band: str, recipients: str = "null") -> str:
    return f"({d(0.04)} * ({band_max(band)}) * ({mult(action, recipients)}))"


def hard_limit(action: str) -> str:
    return f"case {action} when 'issue_refund' then {d(200000)} when 'send_bulk_email' then {d(50000)} end"


def decide(p: str, exposure: str, budget: str, violated: str, k: str = "2") -> str:
    loss = f"coalesce({p}, {d(1)}) * {exposure}"
    return (
        f"case when {violated} or {exposure} is null then 'block' when {exposure} <= 40 then 'act' "
        f"when {loss} <= {budget} then 'act' when {loss} <= {budget} * {k} then 'check_harder' else 'escalate' end"
    )


def region(verdict: str) -> str:
    return f"case {verdict} when 'check_harder' then 'close_call' when 'act' then 'act' else 'escalate' end"


def source_weight(source: str) -> str:
    return f"case {source} " + " ".join(f"when '{s}' then {d(w)}" for s, w in EVIDENCE_WEIGHTS.items()) + f" else {d(0)} end"


def evidence(source: str, outcome_us: str, ts_us: str, as_of_us: int) -> str:
    seen = f"case when {outcome_us} is null or {outcome_us} = 0 then {ts_us} else {outcome_us} end"
    halflife = d(float(SETTINGS.age_halflife_days * 86_400_000_000))
    return f"(({source_weight(source)}) * pow({d(0.5)}, greatest(0, {as_of_us} - ({seen})) / {halflife}))"


STRICT_BY_ACTION = "over (partition by action order by ts_us range between unbounded preceding and 1 preceding)"
