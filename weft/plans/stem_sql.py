"""The English (Porter 2) stemmer as SQL for DuckDB: one query step a rule, as its published description has them; held beside functions.stem in tests and checks."""

from __future__ import annotations

from collections.abc import Sequence

from weft.functions.stem import _KEPT, _SPECIAL, _STEP2, _STEP3, _STEP4

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = f"^{_C}*{_V}+{_C}"
_SHORT = f"({_C}{_V}[^aeiouywxY]$|^{_V}{_C}$)"


def _endings(rules: Sequence[tuple[str, str, str]]) -> str:
    """The first rule (ending, condition on n, replacement) whose ending fits decides, whether its condition holds or not; n is what stays before the ending."""
    cases = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {ok.replace('n', f'(length(w) - {len(e)})', 1)} THEN left(w, length(w) - {len(e)}) || '{to}' ELSE w END" for e, ok, to in rules)
    return f"CASE {cases} ELSE w END"


def stem_steps(words: str) -> str:
    """CTEs for a WITH clause that end in ``stems`` (term, stem), for the different values of ``term`` in the relation ``words``. Terms hold lower-case letters and digits."""
    step2 = _endings([(e, "n >= r1" + (" AND right(w, 4) = 'logi'" if e == "ogi" else " AND regexp_matches(w, '[cdeghkmnrt]li$')" if e == "li" else ""), to) for e, to in _STEP2])
    step3 = _endings([(e, "n >= r2" if e == "ative" else "n >= r1", to) for e, to in _STEP3])
    step4 = _endings([(e, "n >= r2" + (" AND regexp_matches(w, '[st]ion$')" if e == "ion" else ""), "") for e in _STEP4])
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SPECIAL.items())
    kept = ", ".join(f"'{w}'" for w in sorted(_KEPT))
    return f"""
        t0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM {words})),
        t1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
                              WHEN regexp_matches(w, '{_REGION}') THEN length(regexp_extract(w, '{_REGION}')) ELSE length(w) END AS r1 FROM t0),
        t2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_REGION}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{_REGION}')) ELSE length(w) END AS r2 FROM t1),
        a1 AS (SELECT term, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
                                         WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{_V}.+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM t2),
        b1 AS (SELECT *, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM a1),
        b2 AS (SELECT *, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(w) - length(e) >= r1 THEN left(w, length(w) - length(e)) || 'ee' ELSE w END
                              WHEN e <> '' AND regexp_matches(left(w, length(w) - length(e)), '{_V}') THEN left(w, length(w) - length(e)) ELSE w END AS x FROM b1),
        b3 AS (SELECT term, r1, r2, w AS before, CASE WHEN x = w OR e IN ('eed', 'eedly') THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(x, length(x) - 1)
                                             WHEN r1 >= length(x) AND regexp_matches(x, '{_SHORT}') THEN x || 'e' ELSE x END AS w FROM b2),
        c1 AS (SELECT term, r1, r2, before, CASE WHEN regexp_matches(w, '.{_C}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM b3),
        d2 AS (SELECT term, r1, r2, before, {step2} AS w FROM c1), d3 AS (SELECT term, r1, r2, before, {step3} AS w FROM d2), d4 AS (SELECT term, r1, r2, before, {step4} AS w FROM d3),
        d5 AS (SELECT *, CASE WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}')) THEN left(w, length(w) - 1) ELSE w END
                              WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS x FROM d4),
        stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE CASE term {special} ELSE CASE WHEN before IN ({kept}) THEN before ELSE lower(x) END END END AS stem FROM d5)"""
