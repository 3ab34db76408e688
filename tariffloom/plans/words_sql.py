"""SQL for amounts in words, by the same rule as ``functions.text.indian_words`` and written independently of it."""

from __future__ import annotations

from ..functions.text import ONES, TENS

_ONES = "[" + ", ".join(f"'{w}'" for w in ONES) + "]"
_TENS = "[" + ", ".join(f"'{w}'" for w in TENS) + "]"


def _hundred(n: str) -> str:
    tail = f"CASE WHEN {n} % 10 > 0 THEN ' ' || ({_ONES})[{n} % 10 + 1] ELSE '' END"
    return f"CASE WHEN {n} = 0 THEN '' WHEN {n} < 20 THEN ({_ONES})[{n} + 1] ELSE ({_TENS})[{n} // 10 + 1] || {tail} END"


def _crore(n: str) -> str:
    parts = [f"CASE WHEN {p} > 0 THEN {_hundred(p)} || ' {name}' END" for p, name in ((f"({n} // 100000)", "Lakh"), (f"({n} % 100000 // 1000)", "Thousand"), (f"({n} % 1000 // 100)", "Hundred"))]
    return f"concat_ws(' ', {', '.join(parts)}, nullif({_hundred(f'({n} % 100)')}, ''))"


def words_sql(n: str) -> str:
    """For whole numbers below 10**14."""
    upper, lower = f"({n} // 10000000)", f"({n} % 10000000)"
    return f"CASE WHEN {n} = 0 THEN 'Zero' ELSE concat_ws(' ', CASE WHEN {upper} > 0 THEN {_crore(upper)} || ' Crore' END, nullif({_crore(lower)}, '')) END"
