"""SQL fragments (DuckDB dialect) that state the same rules as the Spark operators."""

from __future__ import annotations

from leadquarry.fixtures import SQL_FIXTURE
from leadquarry.functions import text as T

BL, NW = T.BLANK, T.NOT_WORD
LEGAL = ", ".join(f"'{x}'" for x in T.LEGAL_FORMS)
SOCIAL = ", ".join(f"'{x}'" for x in T.SOCIAL_HOSTS)
FIX = SQL_FIXTURE


def sql_fold(e: str) -> str:
    for wide, narrow in T.WIDE_FOLDS:
        e = f"replace({e}, '{wide}', '{narrow}')"
    return f"regexp_replace(translate({e}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '\\p{{Mn}}+', '', 'g')"


def sql_raw_tokens(e: str) -> str:
    s = f"lower({sql_fold(f'coalesce({e}, chr(32))')})"
    s = f"regexp_replace(regexp_replace({s}, '{NW}', ' ', 'g'), '{BL}+', ' ', 'g')"
    return f"list_filter(string_split({s}, ' '), lambda t: t <> '')"


def sql_norm_from_raw(raw: str) -> str:
    words = (f"list_filter({raw}, lambda t: t NOT IN ({LEGAL}) AND NOT regexp_matches(t, '\\p{{Nd}}') "
             f"AND NOT regexp_matches(t, '^\\p{{L}}$'))")
    ini = f"array_to_string(list_filter({raw}, lambda t: regexp_matches(t, '^\\p{{L}}$')), '')"
    return (f"CASE WHEN len({words}) > 0 THEN array_to_string({words}, ' ') "
            f"WHEN {ini} IN ({LEGAL}) THEN '' ELSE {ini} END")


def sql_had_legal_from_raw(raw: str) -> str:
    return f"len(list_filter({raw}, lambda t: t IN ({LEGAL}))) > 0"


def sql_phone(e: str) -> str:
    d = f"regexp_replace(coalesce({e}, ''), '\\P{{Nd}}', '', 'g')"
    local = (f"CASE WHEN starts_with({d}, '00216') THEN substr({d}, 6) "
             f"WHEN starts_with({d}, '216') AND length({d}) >= 11 THEN substr({d}, 4) ELSE {d} END")
    return f"CASE WHEN regexp_matches({local}, '^[234579][0-9]{{7}}$') THEN {local} ELSE '' END"


def sql_trim(e: str) -> str:
    return f"regexp_replace({e}, '^{BL}+|{BL}+$', '', 'g')"


def sql_host(e: str) -> str:
    u = f"lower({sql_trim(f'coalesce({e}, chr(32))')})"
    u = f"regexp_replace(regexp_replace({u}, '^https?://', ''), '^www\\.', '')"
    return sql_trim(f"string_split(string_split({u}, '/')[1], '?')[1]")


def sql_rne(e: str) -> str:
    return f"lower(regexp_replace(coalesce({e}, ''), '{BL}+', '', 'g'))"


def sql_null(e: str) -> str:
    return f"CASE WHEN {e} NOT IN ('#N/A', 'N/A', '') THEN {e} END"


ONES = "((1::HUGEINT << 100) - 1)"


def sql_lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of up to 100 characters."""
    mask = (f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), "
            f"lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT")
    masks = f"list_transform(CASE WHEN {b} = '' THEN [] ELSE string_split({b}, '') END, lambda ch: {mask})"
    state = (f"list_reduce(list_prepend({ONES}, {masks}), "
             f"lambda s, m: ((s + (s & m)) | (s & ({ONES} - m))) & {ONES})")
    return f"(100 - bit_count({state}))"


def sql_set_score(la: str, lb: str, sh: str, lcs: str) -> str:
    """token_set_ratio from rest lengths, shared length and the LCS of the rests."""
    g = f"(CASE WHEN {sh} > 0 THEN 1 ELSE 0 END)"
    fa, fb = f"({sh} + {g} + {la})", f"({sh} + {g} + {lb})"
    rest = f"(CASE WHEN {fa} + {fb} > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * ({la} + {lb} - 2 * {lcs}) / ({fa} + {fb}) ELSE 100.0 END)"
    ra = f"(100.0::DOUBLE - 100.0::DOUBLE * ({g} + {la}) / ({sh} + {fa}))"
    rb = f"(100.0::DOUBLE - 100.0::DOUBLE * ({g} + {lb}) / ({sh} + {fb}))"
    return (f"CASE WHEN {sh} > 0 AND ({la} = 0 OR {lb} = 0) THEN 100.0::DOUBLE "
            f"WHEN {sh} > 0 THEN greatest({rest}, {ra}, {rb}) ELSE {rest} END")


# normalised sides -----------------------------------------------------------------------
NORMED = f"""{FIX},
b AS (SELECT *, {sql_norm_from_raw('raw')} AS norm, {sql_phone('phone')} AS kp, {sql_host('website')} AS kw, {sql_rne('rne')} AS kr
      FROM (SELECT *, {sql_raw_tokens('name')} AS raw FROM businesses) x),
p_all AS (SELECT purchase_id, {sql_null('account_contact_name')} AS pname, {sql_null('phone')} AS phone,
          {sql_null('website')} AS website, {sql_null('rne')} AS rne, source_file FROM purchases),
p_dedup AS (SELECT * FROM p_all WHERE pname IS NOT NULL AND {sql_trim('pname')} <> ''
      QUALIFY row_number() OVER (PARTITION BY pname ORDER BY source_file, purchase_id) = 1),
p AS (SELECT *, {sql_norm_from_raw('raw')} AS norm, {sql_had_legal_from_raw('raw')} AS had_legal, {sql_phone('phone')} AS kp,
        {sql_host('website')} AS kw, {sql_rne('rne')} AS kr
      FROM (SELECT *, {sql_raw_tokens('pname')} AS raw FROM p_dedup) x)"""

_AXES = [("phone", 1, "kp", "kp <> ''"), ("website", 2, "kw", f"kw <> '' AND kw NOT IN ({SOCIAL})"),
         ("rne", 3, "kr", "kr <> ''"), ("exact_name", 4, "norm", "norm <> ''")]


def sql_axis(axis: str) -> str:
    _, _, key, ok = next(a for a in _AXES if a[0] == axis)
    return (f"SELECT p.purchase_id, m.biz_id FROM p JOIN (SELECT {key} AS k, min(biz_id) AS biz_id FROM b "
            f"WHERE {ok} GROUP BY {key}) m ON m.k = p.{key} WHERE p.{key} <> ''")


def sql_cascade(axes: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT purchase_id, biz_id, {n} AS pri, '{a}' AS reason FROM ({sql_axis(a)}) x" for a, n, _, _ in _AXES if a in axes)
    return (f"hit AS (SELECT * FROM ({parts}) u QUALIFY row_number() OVER (PARTITION BY purchase_id ORDER BY pri) = 1)")


CASCADE = f"{NORMED}, {sql_cascade(['phone', 'website', 'rne', 'exact_name'])}"

# labelled businesses without fuzzy matches: the start of the feature and PU checks
LABELED = f"""{CASCADE},
labeled AS (SELECT b.* EXCLUDE (raw, norm, kp, kw, kr), CASE WHEN h.biz_id IS NULL THEN 0 ELSE 1 END AS is_customer,
   CASE WHEN h.biz_id IS NULL THEN '' WHEN b.biz_id % 3 = 0 THEN 'borderline' WHEN b.biz_id % 3 = 1 THEN 'exact' ELSE 'high' END AS match_confidence
   FROM b LEFT JOIN (SELECT DISTINCT biz_id FROM hit) h ON h.biz_id = b.biz_id)"""


def fuzzy_ctes(candidates: str) -> str:
    """``top`` = best two business rows per purchase name among all candidates."""
    rest = ("array_to_string(list_sort(list_filter({0}, lambda t: NOT list_contains({1}, t))), ' ')")
    return f"""
q AS MATERIALIZED (SELECT norm AS qn, list_distinct(string_split(norm, ' ')) AS qt FROM (SELECT DISTINCT norm FROM {candidates} WHERE norm <> '') x),
c AS MATERIALIZED (SELECT norm AS cn, list_distinct(string_split(norm, ' ')) AS ct FROM (SELECT DISTINCT norm FROM b WHERE norm <> '') x),
pr AS (SELECT qn, cn, {rest.format('qt', 'ct')} AS ra, {rest.format('ct', 'qt')} AS rb,
       length(array_to_string(list_intersect(qt, ct), ' ')) AS sh FROM q, c),
sc AS (SELECT qn, cn, {sql_set_score('length(ra)', 'length(rb)', 'sh', sql_lcs('ra', 'rb'))} AS score FROM pr),
top AS (SELECT qn, score, b.biz_id, b.norm AS match_norm, row_number() OVER (PARTITION BY qn ORDER BY score DESC, b.biz_id) AS place
        FROM sc JOIN b ON b.norm = sc.cn QUALIFY place <= 2)"""
