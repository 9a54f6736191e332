"""The queries once more, as SQL for DuckDB.

The statements follow the definitions of the operators in their own way (split
lists, recursive picks, explicit subsets), so that agreement means something.
RE2 has no look-around: identifiers of digits are taken as maximal runs, and
mobiles are tried at every position of texts that can hold one.
"""

from itertools import combinations

from catalog.subjects import COLUMNS, subjects_sql
from veilframe import fixed_values as V
from veilframe.plans.profiles import PROFILES, REASONS

SALT = "pepper"
SPACES = r"\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERNS = ["SAUDI_NATIONAL_ID", "SAUDI_MOBILE", "SAUDI_IBAN", "EMAIL_ADDRESS"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN = r"(?i)\bSA[0-9]{2}\s?(?:[0-9A-Z]{4}\s?){4}[0-9A-Z]{4}\b"
MOBILE = r"(?:\+?966|00966|0)?[\s-]?5[0-9][\s-]?[0-9]{3}[\s-]?[0-9]{4}"
DIRECT = [e for e, (c, _, _) in V.ENTITIES.items() if c == "Direct"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def q_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def nd(x: str) -> str:
    return f"translate({x}, '{V.ARABIC_DIGITS}', '{V.ASCII_DIGITS}')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def fold(x: str) -> str:
    marks = r"[\x{064B}-\x{0652}\x{0640}]"
    return f"lower({strip(f'''translate(regexp_replace({x}, '{marks}', '', 'g'), '{V.ARABIC_LETTERS}', '{V.ARABIC_FOLDED}')''')})"


def number(x: str) -> str:
    plain = strip(f"replace({nd(x)}, ',', '')")
    d = "[0-9]+(_[0-9]+)*"
    return (f"case when regexp_full_match({plain}, '[+-]?({d}\\.?({d})?|\\.{d})([eE][+-]?{d})?') "
            f"then try_cast(replace({plain}, '_', '') as double) end")


def midpoint(x: str) -> str:
    plain = f"replace({x}, ',', '')"
    band = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*[–-]\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    return (f"case when regexp_matches({plain}, '{band}') then (cast(regexp_extract({plain}, '{band}', 1) as double) "
            f"+ cast(regexp_extract({plain}, '{band}', 2) as double)) / 2 else {number(x)} end")


def round2(x: str) -> str:
    return f"cast(printf('%.2f', {x}) as double)"


def whole(x: str) -> str:
    """Nearest whole number, ties to even."""
    return f"cast(printf('%.0f', {x}) as bigint)"


def id_valid(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    total = " + ".join(
        f"cast(substr('0246813579', cast(substr({d}, {i}, 1) as int) + 1, 1) as int)" if i % 2
        else f"cast(substr({d}, {i}, 1) as int)" for i in range(1, 11))
    return f"case when regexp_full_match({d}, '[12][0-9]{{9}}') then ({total}) % 10 = 0 else false end"


def iban_valid(x: str) -> str:
    compact = f"upper(regexp_replace({x}, '[{SPACES}]+', '', 'g'))"
    values = (f"list_transform(string_split(substr({compact}, 5) || substr({compact}, 1, 4), ''), "
              "lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)")
    rest = f"list_reduce({values}, lambda a, c: (a * (case when c > 9 then 100 else 10 end) + c) % 97, 0)"
    return f"case when regexp_full_match({compact}, 'SA[0-9]{{2}}[0-9A-Z]{{20}}') then {rest} = 1 else false end"


def known_city(x: str) -> str:
    cities = ", ".join(fold(q(c)) for c in V.CITIES_EN + V.CITIES_AR)
    return f"{fold(x)} in ({cities})"


def region(x: str) -> str:
    pairs = " ".join(f"when {fold(q(c))} then {q(r)}" for c, r in V.CITY_REGION.items())
    return f"case {fold(x)} {pairs} end"


def keyword_hits(x: str) -> str:
    """Address keywords at a word start, in list order."""
    tests = ", ".join(
        f"case when regexp_matches(folded, '(^|[^\\pL\\pN_])' || regexp_escape({fold(q(k))})) then {q(k)} end"
        for k in V.ADDRESS_KEYWORDS)
    return f"list_filter([{tests}], lambda w: w is not null)".replace("folded", x)


NAME_GAP = rf"[{SPACES}\-]"
NAME_LETTER = r"[\pL\p{Nl}\p{No}]"


def name_parts(x: str) -> dict[str, str]:
    shape = (f"regexp_full_match({x}, '{NAME_GAP}*{NAME_LETTER}+({NAME_GAP}+{NAME_LETTER}+){{1,4}}{NAME_GAP}*')")
    words = f"string_split_regex({fold(x)}, '{NAME_GAP}+')"
    lexicon = "[" + ", ".join(fold(q(w)) for w in V.AR_FIRST_NAMES + V.AR_FAMILY_NAMES + V.EN_FIRST_NAMES
                              + V.EN_FAMILY_NAMES + V.NAME_PARTICLES) + "]"
    bare = "[" + ", ".join(f"regexp_replace({fold(q(w))}, '^ال', '')" for w in V.AR_FAMILY_NAMES) + "]"
    hit = (f"(list_has_any({words}, {lexicon}) or list_has_any("
           f"list_transform({words}, lambda w: regexp_replace(w, '^ال', '')), {bare}))")
    arabic = rf"regexp_matches({x}, '[\x{{0600}}-\x{{06FF}}]')"
    return {"shape_ok": shape, "lexicon_hit": f"({shape} and {hit})", "is_arabic": f"({shape} and {arabic})"}


# --------------------------------------------------------------------------- masks
def alnum_count(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\pL\\pN]', '', 'g'))"


def mask_alnum(v: str, ks: int, ke: int) -> str:
    n = alnum_count(v)
    start = f"case when {n} <= {ks + ke + 1} then {min(ks, 1)} else {ks} end"
    end = f"case when {n} <= {ks + ke + 1} then 0 else {ke} end"
    nth = alnum_count(f"substr({v}, 1, i)")
    return (f"array_to_string(list_transform(string_split({v}, ''), lambda c, i: case when regexp_matches(c, '[\\pL\\pN]') "
            f"and {nth} > {start} and {nth} <= {n} - {end} then '*' else c end), '')")


def mask(v: str, entity: str, strength: str) -> str:
    if entity in ("SAUDI_NATIONAL_ID", "SAUDI_MOBILE"):
        digits = f"regexp_replace({nd(v)}, '[^0-9]', '', 'g')"
        if entity == "SAUDI_MOBILE":
            digits = f"(case when length({digits}) >= 9 then '0' || right({digits}, 9) else {digits} end)"
        return mask_alnum(digits, *V.MASK_KEEPS[entity][strength])
    if entity == "SAUDI_IBAN":
        return mask_alnum(f"upper(regexp_replace({nd(v)}, '[{SPACES}]', '', 'g'))", *V.MASK_KEEPS[entity][strength])
    if entity == "EMAIL_ADDRESS":
        domain = f"substr({v}, strpos({v}, '@') + 1)"
        label = f"regexp_extract({domain}, '([^.]*)$', 1)"
        hidden = (f"(case when contains({domain}, '.') and {label} <> '' then '***.' || {label} else '***' end)"
                  if strength == "strong" else domain)
        first = f"(case when strpos({v}, '@') = 1 then '' else substr({v}, 1, 1) end)"
        return (f"case when contains({v}, '@') then {first} || '***@' || {hidden} "
                f"else {mask_alnum(v, *V.DEFAULT_KEEPS[strength])} end")
    if entity == "PERSON_NAME":
        return (f"array_to_string(list_transform(string_split_regex({strip(v)}, '[{SPACES}]+'), "
                "lambda w: substr(w, 1, 1) || repeat('*', length(w) - 1)), ' ')")
    return mask_alnum(v, *V.DEFAULT_KEEPS[strength])


# --------------------------------------------------------------------------- spans
def _piece_spans(source: str, entity: str, pattern: str, candidate: str, wanted: str = "true") -> str:
    """Spans of a pattern without look-around: lengths of the pieces and matches before each match."""
    return f"""
  select id, {q(entity)} as entity, cast(s as int) as s, cast(s + length(frag) as int) as e, frag from (
    select id, hits[i] as frag,
           coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0)
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as s
    from (select id, pieces, hits, unnest(range(1, len(hits) + 1)) as i
          from (select id, string_split_regex(t, '{pattern}') as pieces, regexp_extract_all(t, '{pattern}') as hits
                from {source} where {candidate})))
  where {wanted}"""


def spans(source: str, p: str) -> str:
    """CTEs that end in ``{p}_spans(id, entity, s, e, frag)`` for source(id, t) with normalised t."""
    return f"""
{p}_at as (
  select id, cast(pos - 1 as int) as s, regexp_extract(substr(t, pos, 24), '^({MOBILE})(?:[^0-9]|$)', 1) as frag
  from (select id, t, unnest(range(1, length(t) + 1)) as pos from {source}
        where regexp_matches(t, '5[0-9][\\s-]?[0-9]{{3}}[\\s-]?[0-9]{{4}}'))
  where regexp_matches(substr(t, pos, 1), '[0-9+\\s-]') and not regexp_matches(substr(t, pos - 1, 1), '[0-9+]')),
{p}_tried as (
  select id, {{'s': s, 'e': cast(s + length(frag) as int), 'frag': frag}} as sp from {p}_at where frag <> ''),
{p}_mobile as (
  select id, min(sp) as sp from {p}_tried group by id
  union all
  select t.id, min(t.sp) from {p}_mobile m join {p}_tried t on t.id = m.id and t.sp.s >= m.sp.e group by t.id),
{p}_spans as (
  {_piece_spans(source, 'SAUDI_NATIONAL_ID', '[0-9]+', "regexp_matches(t, '[12][0-9]{9}')",
                "length(frag) = 10 and frag[1] in ('1', '2')")}
  union all
  {_piece_spans(source, 'SAUDI_IBAN', IBAN, "regexp_matches(t, '(?i)SA[0-9]{2}')")}
  union all
  {_piece_spans(source, 'EMAIL_ADDRESS', EMAIL, "contains(t, '@')")}
  union all
  select id, 'SAUDI_MOBILE', sp.s, sp.e, sp.frag from {p}_mobile)"""


def kept_spans(p: str) -> str:
    """CTE ``{p}_kept(id, sp)``: overlaps resolved by (start, end, entity)."""
    return f"""
{p}_all as (select id, {{'s': s, 'e': e, 'entity': entity, 'frag': frag}} as sp from {p}_spans),
{p}_kept as (
  select id, min(sp) as sp from {p}_all group by id
  union all
  select a.id, min(a.sp) from {p}_kept k join {p}_all a on a.id = k.id and a.sp.s >= k.sp.e group by a.id)"""


def masked_texts(source: str, p: str, strength: str) -> str:
    """CTE ``{p}_masked(id, text)`` for source(id, t, raw): kept spans of raw replaced by their masks."""
    value = "substr(raw, sp.s + 1, sp.e - sp.s)"
    masks = " ".join(f"when {q(e)} then {mask('v', e, strength)}" for e in PATTERNS)
    return f"""
{p}_cut as (
  select id, raw, sp, coalesce(lag(sp.e) over (partition by id order by sp.s), 0) as last_end, {value} as v
  from {p}_kept join {source} using (id)),
{p}_joined as (
  select id, string_agg(substr(raw, last_end + 1, sp.s - last_end) || (case sp.entity {masks} end), ''
                        order by sp.s) as head, max(sp.e) as tail
  from {p}_cut group by id),
{p}_masked as (
  select id, case when head is null then raw else head || substr(raw, tail + 1) end as text
  from {source} left join {p}_joined using (id))"""


def context(t: str, s: str, e: str, entity: str) -> str:
    before = f"substr({t}, greatest({s} - {V.CONTEXT_BEFORE}, 0) + 1, {s} - greatest({s} - {V.CONTEXT_BEFORE}, 0))"
    segment = fold(f"{before} || ' ' || substr({t}, {e} + 1, {V.CONTEXT_AFTER})")
    tests = ", ".join(f"case when contains(seg, {fold(q(k))}) then {q(k)} end" for k in V.CONTEXT_KEYWORDS[entity])
    return (f"list_transform([{segment}], lambda seg: list_filter([{tests}], lambda w: w is not null)[1])[1]")


def any_context(t: str = "t", s: str = "s", e: str = "e") -> str:
    return "case entity " + " ".join(f"when {q(x)} then {context(t, s, e, x)}" for x in PATTERNS) + " end"


VALID = (f"case entity when 'SAUDI_NATIONAL_ID' then {id_valid('frag')} "
         f"when 'SAUDI_IBAN' then {iban_valid('frag')} else true end")
SUBJECTS = f"subjects as materialized ({subjects_sql()})"
CARD = """
cards as (select c_custkey, concat_ws(' | ', notes, national_id, mobile, iban, email, order_ref) as card from subjects)"""
TEXTS = f"""{CARD},
texts as materialized (
  select id, raw, {nd('raw')} as t from (
    select concat('document ', doc_id) as id, text as raw from documents
    union all select concat('page ', page_id), html from pages
    union all select concat('turn ', conv_id, '.', turn), text from conversations
    union all select concat('note ', c_custkey), notes from subjects
    union all select concat('card ', c_custkey), card from cards))"""


def with_(*ctes: str) -> str:
    return "with recursive " + ",\n".join((SUBJECTS, *ctes)) + "\n"


# --------------------------------------------------------------------------- detection
def cells(columns=COLUMNS) -> str:
    parts = [f"select c_custkey as k, {q(c)} as col, {strip(c)} as v from subjects where {strip(c)} <> ''" for c in columns]
    return "cells as materialized (" + "\n union all ".join(parts) + ")"


# what the column names say, read off by hand
HINTS = [("national_id", "SAUDI_NATIONAL_ID", "national id"), ("mobile", "SAUDI_MOBILE", "mobile"),
         ("iban", "SAUDI_IBAN", "iban"), ("email", "EMAIL_ADDRESS", "email"), ("customer_name_ar", "PERSON_NAME", "name"),
         ("customer_name_en", "PERSON_NAME", "name"), ("address_ar", "SAUDI_ADDRESS", "address"),
         ("customer_id", "CUSTOMER_ID", "customer id"), ("age", "AGE", "age"), ("birth_date", "DATE_OF_BIRTH", "birth"),
         ("city", "CITY", "city"), ("district", "DISTRICT", "district"), ("gender", "GENDER", "gender"),
         ("job", "JOB_TITLE", "job"), ("salary", "SALARY", "salary")]
HINTS_CTE = "hints(col, entity, keyword) as (values " + ", ".join(
    f"({q(c)}, {q(e)}, {q(k)})" for c, e, k in HINTS) + ")"


def _pattern_rows() -> str:
    rows = []
    for place, entity in enumerate(PATTERNS):
        pw, vw, _ = V.PATTERN_WEIGHTS[entity]
        rows.append(f"""
  select col, '{entity}' as entity, {place} as place, coalesce(embedded, false) as embedded,
    case when hits = 0 then 0.3::double else
      {pw}::double * (case when embedded then least(1.0::double, hits / 3.0::double) else hits / n::double end)
      + {vw}::double * (case when embedded then valid / hits::double else valid / n::double end)
      + case when not embedded and full_n / hits::double >= 0.8 then 0.02::double else 0 end
      + case when keyword is not null then 0.35::double else 0 end
      + 0.35::double * (ctx / hits::double) end as raw
  from (select *, hits > 0 and full_n / hits::double < 0.5 as embedded from (
    select c.col, n, keyword, coalesce(hits, 0) as hits, valid, full_n, ctx
    from counts c left join (select * from by_entity where entity = '{entity}') b on b.col = c.col
                  left join hints h on h.col = c.col and h.entity = '{entity}'))
  where hits > 0 or keyword is not null""")
    return "\n union all ".join(rows)


def _hinted(entity: str, place: int, raw: str, wanted: str = "keyword is not null") -> str:
    return f"""select c.col, '{entity}' as entity, {place} as place, false as embedded, {raw} as raw
  from counts c left join hints h on h.col = c.col and h.entity = '{entity}' where {wanted}"""


def _other_rows() -> str:
    hinted = "case when keyword is not null then 0.7::double else 0 end"
    return "\n union all ".join([
        f"""select c.col, case when case when shape > 0 then arabic / shape::double >= 0.5 else
             regexp_matches(c.col, '[\\x{{0600}}-\\x{{06FF}}]') end then 'ARABIC_PERSON_NAME' else 'PERSON_NAME' end as entity,
             4 as place, false as embedded,
             0.35::double * shape / n + 0.15::double * lexicon / n + case when keyword is not null then 0.4::double else 0 end as raw
           from counts c left join hints h on h.col = c.col and h.entity = 'PERSON_NAME'
           where shape > 0 or keyword is not null""",
        f"""select c.col, 'SAUDI_ADDRESS', 5, false,
             0.5::double * address_n / n + case when h.keyword is not null then 0.4::double else 0 end
           from counts c left join hints h on h.col = c.col and h.entity = 'SAUDI_ADDRESS'
                         left join hints d on d.col = c.col and d.entity = 'DISTRICT'
           where (h.keyword is not null or d.keyword is null) and (address_n > 0 or h.keyword is not null)""",
        _hinted("CUSTOMER_ID", 6, "0.65::double + 0.25::double * (uniq / n::double)"),
        _hinted("AGE", 7, "0.7::double + 0.25::double * (age_n / n::double)"),
        _hinted("SALARY", 8, "0.7::double + 0.25::double * (number_n / n::double)"),
        _hinted("DATE_OF_BIRTH", 9, "0.7::double + 0.25::double * (date_n / n::double)"),
        _hinted("CITY", 10, f"{hinted} + case when keyword is not null then 0.25::double else 0.6::double end * (city_n / n::double)",
                "keyword is not null or city_n / n::double >= 0.8"),
        _hinted("DISTRICT", 11, "0.7::double"),
        _hinted("GENDER", 12, "0.7::double + case when uniq <= 4 then 0.25::double else 0 end"),
        _hinted("JOB_TITLE", 13, "0.7::double"),
        _hinted("NATIONALITY", 14, "0.7::double")])


_NAME = name_parts("v")
DETECTION = f"""{HINTS_CTE}, {cells()},
cell_texts as materialized (select concat(col, ':', k) as id, col, k, v, {nd('v')} as t from cells),
{spans('cell_texts', 'c')},
firsts as (select id, entity, min({{'s': s, 'e': e}}) as f, bool_or({VALID}) as valid from c_spans group by id, entity),
judged as (
  select c.col, c.k, c.v, f.entity, f.valid, (f.f.e - f.f.s) >= 0.8 * length(c.t) as whole_cell,
         {any_context('c.t', 'f.f.s', 'f.f.e')} as keyword
  from firsts f join cell_texts c using (id)),
by_entity as (
  select col, entity, count(*) as hits, count(*) filter (where valid) as valid,
         count(*) filter (where whole_cell) as full_n, count(keyword) as ctx,
         arg_min(keyword, k) filter (where keyword is not null) as first_keyword, list(v order by k)[1:3] as firsts
  from judged group by col, entity),
counts as materialized (
  select col, count(*) as n, count(distinct v) as uniq,
         count(*) filter (where {_NAME['shape_ok']}) as shape, count(*) filter (where {_NAME['lexicon_hit']}) as lexicon,
         count(*) filter (where {_NAME['is_arabic']}) as arabic,
         count(*) filter (where length(v) >= 10 and len({keyword_hits(fold('v'))}) > 0) as address_n,
         count({number('v')}) as number_n, count(*) filter (where {number('v')} between 0 and 120) as age_n,
         count(*) filter (where regexp_matches({nd('v')}, '^[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}')) as date_n,
         count(*) filter (where {known_city('v')}) as city_n
  from cells group by col),
entity_facts(entity, category, base_risk, label) as (values
  {", ".join(f"({q(e)}, {q(c)}, {q(r)}, {q(label)})" for e, (c, r, label) in V.ENTITIES.items())}),
every_finding as (
  select col as column_name, entity, place, embedded, category, base_risk, label, confidence, confidence >= 0.5 as flagged,
    case when confidence < 0.7 then case base_risk when 'HIGH' then 'MEDIUM' else 'LOW' end else base_risk end as risk
  from (select r.*, f.* exclude (entity), {round2('least(raw, 0.99::double)')} as confidence
        from ({_pattern_rows()} union all {_other_rows()}) r join entity_facts f using (entity))),
detections as materialized (
  select * exclude (nth) from (
    select *, row_number() over (partition by column_name, place >= 4
                                 order by confidence desc, category = 'Direct' desc, place) as nth from every_finding)
  where place < 4 or nth = 1)"""
def share(a: str, b: str) -> str:
    return f"({a} || '/' || {b} || ' values (' || {whole(f'100.0::double * {a} / greatest({b}, 1)')} || '%)')"


def _listed(*reasons: str) -> str:
    return f"array_to_string(list_filter([{', '.join(reasons)}], lambda r: r is not null), '|')"


def _explained() -> str:
    """CTE ``explained(col, entity, reasons, samples)`` of every possible finding."""
    named = "case when keyword is not null then 'Column name contains ''' || keyword || '''' end"
    shown = "array_to_string({}, '|')"
    rows = []
    for entity in PATTERNS:
        label = V.PATTERN_WEIGHTS[entity][2]
        checked = entity in ("SAUDI_NATIONAL_ID", "SAUDI_IBAN")
        reasons = _listed(
            f"case when hits is null then 'Column name contains ''' || keyword || ''' but no value matches the {label} pattern' end",
            f"case when hits > 0 then 'Matches {label} pattern ' || case when full_n / hits::double < 0.5 then 'inside free text' "
            f"else 'in the whole cell' end || ' in ' || {share('hits', 'n')} end",
            f"case when hits > 0 then case when valid > 0 then 'Passes the {label} checksum in ' || {share('valid', 'hits')} else "
            f"'Pattern matches but the checksum FAILS ({label}) → probably not a real identifier' end end" if checked else "null",
            f"case when hits > 0 then {named} end",
            f"case when ctx > 0 then 'Context phrase ''' || first_keyword || ''' found next to the value in ' || {share('ctx', 'hits')} end",
            "case when hits > 0 and keyword is null and ctx = 0 "
            "then 'No supporting context (column name / nearby words) → confidence stays limited' end")
        samples = shown.format("list_transform(firsts, lambda v: substr(v, 1, 60))")
        rows.append(f"""select c.col, '{entity}' as entity, {reasons} as reasons, coalesce({samples}, '') as samples
          from counts c left join (select * from by_entity where entity = '{entity}') b on b.col = c.col
                        left join hints h on h.col = c.col and h.entity = '{entity}'""")
    raw = "(0.35::double * shape / n + 0.15::double * lexicon / n)"
    for entity in ("PERSON_NAME", "ARABIC_PERSON_NAME"):
        reasons = _listed(
            f"case when shape > 0 then {share('shape', 'n')} || ' look like personal names (2–5 alphabetic words)' end",
            f"case when lexicon > 0 then 'Saudi/Arabic name lexicon or particle (بن / آل / bin / Al) found in ' || {share('lexicon', 'n')} end",
            named,
            f"case when keyword is null and {raw} < 0.5 then 'No ''name'' column context → treated as a weak candidate' end")
        rows.append(f"select c.col, '{entity}', {reasons}, coalesce({shown.format('name_firsts')}, '') from counts c "
                    "left join hints h on h.col = c.col and h.entity = 'PERSON_NAME' left join seen on seen.col = c.col")
    address = _listed(
        "case when address_n > 0 then 'Address keywords (' || array_to_string(list_sort(list_distinct(words))[1:4], ', ') "
        f"|| ') found in ' || {share('address_n', 'n')} end", named)
    rows.append(f"select c.col, 'SAUDI_ADDRESS', {address}, coalesce({shown.format('address_firsts')}, '') from counts c "
                "left join hints h on h.col = c.col and h.entity = 'SAUDI_ADDRESS' left join seen on seen.col = c.col")

    def rate(count: str, text: str) -> str:
        return f"case when {count} > 0 then {whole(f'100 * ({count} / n::double)')} || '% of values {text}' end"
    said = {
        "CUSTOMER_ID": rate("uniq", "are unique (behaves like an identifier)"), "AGE": rate("age_n", "are plausible ages (0–120)"),
        "SALARY": rate("number_n", "are numeric amounts"), "DATE_OF_BIRTH": rate("date_n", "look like dates"),
        "CITY": rate("city_n", "are known Saudi cities"),
        "GENDER": "case when uniq <= 4 then 'Only ' || uniq || ' distinct values (typical for gender)' end",
        "DISTRICT": "null", "JOB_TITLE": "null", "NATIONALITY": "null"}
    combined = q("Indirect identifier: risky when COMBINED with other fields (suggested – please confirm)")
    for entity, reason in said.items():
        reasons = _listed(named, reason, "null" if entity == "CUSTOMER_ID" else combined)
        rows.append(f"select c.col, '{entity}', {reasons}, {shown.format('any_firsts')} from counts c "
                    f"left join hints h on h.col = c.col and h.entity = '{entity}' left join seen on seen.col = c.col")
    return f"""
seen as materialized (
  select col, list(v order by k)[1:3] as any_firsts,
         (list(v order by k) filter (where {_NAME['shape_ok']}))[1:3] as name_firsts,
         (list(v order by k) filter (where hit))[1:3] as address_firsts, flatten(list(words[1:2]) filter (where hit)) as words
  from (select *, length(v) >= 10 and len(words) > 0 as hit from (select *, {keyword_hits(fold('v'))} as words from cells))
  group by col),
explained as ({' union all '.join(rows)})"""


FOUND = 'column_name as "column", entity, category, confidence, risk, embedded, flagged'


def detection_query(body: str) -> str:
    return with_(DETECTION) + body


def finding_query(*entities: str) -> str:
    return detection_query(f"select {FOUND} from every_finding where entity in ({', '.join(map(q, entities))})")


# --------------------------------------------------------------------------- treated tables
def width_of(low: str, high: str, bins: str) -> str:
    raw = f"((case when {high} = {low} then 1.0::double else {high} - {low} end) / {bins})"
    listed = ", ".join(f"{{'d': abs(ln({w}::double / {raw})), 'i': {i}, 'w': {w}::double}}" for i, w in enumerate(V.BAND_WIDTHS))
    return f"list_min([{listed}]).w"


def band(x: str, width: str) -> str:
    low = f"(floor({number(x)} / {width}) * {width})"
    return (f"case when {number(x)} is null then {x} else format('{{:,}}', cast({low} as bigint)) || '–' || "
            f"format('{{:,}}', cast({low} + {width} as bigint)) end")


def year_of(x: str, strong: bool) -> str:
    year = f"regexp_extract({nd(x)}, '([0-9]{{4}})', 1)"
    shown = f"cast(cast({year} as int) // 10 * 10 as varchar) || 's'" if strong else f"cast(cast({year} as int) as varchar)"
    return f"case when {year} = '' then {x} else {shown} end"


def address_area(x: str) -> str:
    # the comma after the area is consumed and dropped, for want of look-ahead
    area = r"(حي\s+\S+(?:\s+\S+)?)[،,]"
    english = r"(\S+(?:\s\S+)?\s+District)"
    return (f"case when {x} is null then null when regexp_matches({x}, '{area}') then regexp_extract({x}, '{area}', 1) "
            f"when regexp_matches({x}, '{english}') then regexp_extract({x}, '{english}', 1) else '{V.ADDRESS_GENERALIZED}' end")


def merged(source: str, column: str, frac: float) -> str:
    return (f"case when {column} is null or {column} in (select {column} from {source} where {column} is not null group by "
            f"{column} having count(*) >= (select greatest(2, ceil({frac}::double * count({column}))) from {source})) "
            f"then {column} else 'Other' end")


def replaced(column: str, prefix: str) -> str:
    return (f"(select {column} as {column}_v, row_number() over (order by min(c_custkey)) as {column}_n from subjects "
            f"where {strip(column)} <> '' group by {column}) {column}_map on {column}_v = {column}")


def pseudonym(column: str, prefix: str) -> str:
    n = f"{column}_n"
    return (f"case when {strip(column)} = '' then {column} else '{prefix}_' || "
            f"case when {n} < 1000 then lpad(cast({n} as varchar), 3, '0') else cast({n} as varchar) end end")


BINS = {"external": 3, "developer": 8, "internal": 12}
FRACS = {"external": 0.10, "developer": 0.05, "internal": 0.05}
STRENGTHS = {"external": "strong", "developer": "medium", "internal": "medium"}


def _unless_blank(column: str, treated: str) -> str:
    return f"case when {column} is null or {strip(column)} = '' then {column} else {treated} end"


def treated(profile: str) -> str:
    """CTE ``treated``: the subjects under a profile (fakes of the developer profile left out)."""
    strength, bins, frac = STRENGTHS[profile], BINS[profile], FRACS[profile]
    entity = {"national_id": "SAUDI_NATIONAL_ID", "mobile": "SAUDI_MOBILE", "email": "EMAIL_ADDRESS", "iban": "SAUDI_IBAN"}
    columns = {c: c for c in COLUMNS}
    columns["customer_id"] = f"'H_' || left(sha256('{SALT}' || customer_id), 10)"
    for c in ("customer_name_ar", "customer_name_en"):
        columns[c] = pseudonym(c, "Person") if profile != "developer" else "null::varchar"
    removed = ["national_id", "iban", "address_ar", "district"] if profile == "external" else []
    masked = {"external": ["mobile", "email"], "developer": [], "internal": list(entity)}[profile]
    for c in removed:
        columns[c] = f"case when {c} is not null then '{V.REMOVED}' end"
    for c in masked:
        columns[c] = _unless_blank(c, mask(c, entity[c], strength))
    if profile == "developer":
        columns |= {c: "null::varchar" for c in entity}
    columns["notes"] = "masked_note"
    for c in ("age", "salary"):
        columns[c] = band(c, f"{c}_width")
    columns["birth_date"] = year_of("birth_date", strength == "strong")
    if profile == "external":
        columns["city"] = f"coalesce({region('city')}, 'Other')"
        columns["job"] = merged("subjects", "job", frac)
    else:
        columns["address_ar"] = address_area("address_ar")
        columns["district"] = merged("subjects", "district", frac)
    joins = "" if profile == "developer" else " ".join(
        f"left join {replaced(c, 'Person')}" for c in ("customer_name_ar", "customer_name_en"))
    listed = ", ".join(f"{x} as {c}" for c, x in columns.items())
    before = ", ".join(f"s.{c} as {c}__before" for c in COLUMNS)
    p = profile[:3]
    return f"""
{p}_notes as (select c_custkey as id, notes as raw, {nd('notes')} as t from subjects),
{spans(f'{p}_notes', p)}, {kept_spans(p)}, {masked_texts(f'{p}_notes', p, strength)},
{p}_widths as (select {width_of('min(a)', 'max(a)', str(bins))} as age_width, {width_of('min(s)', 'max(s)', str(bins))} as salary_width,
    max(a) - min(a) as age_range, max(s) - min(s) as salary_range
  from (select {number('age')} as a, {number('salary')} as s from subjects)),
{p}_plain as (select s.*, text as masked_note, age_width, salary_width from subjects s
  join {p}_masked m on m.id = s.c_custkey cross join {p}_widths),
{p}_treated as materialized (select c_custkey, {listed} from {p}_plain {joins}),
{p}_paired as materialized (select t.*, {before} from {p}_treated t join subjects s using (c_custkey)),
{p}_left as (select c_custkey as id, {nd('notes')} as t from {p}_treated), {spans(f'{p}_left', p + '_l')}"""


def _drawn(text: str, size: int) -> str:
    """The number that the first hexadecimal digits of a hash write."""
    return f"('0x' || substr(sha256({text}), 1, {size}))::bigint"


def _laid_out(like: str, compact: str) -> str:
    """The characters of ``compact`` at the places where ``like`` has letters or digits."""
    at = "substr({x}, 1, i)".format(x=like)
    return (f"array_to_string(list_transform(range(1, length({like}) + 1), lambda i: case when regexp_matches(substr({like}, i, 1), '[0-9A-Za-z]') "
            f"then substr({compact}, length(regexp_replace({at}, '[^0-9A-Za-z]', '', 'g')), 1) else substr({like}, i, 1) end), '')")


def _fake_name(column: str, first: list[str], family: list[str], joint: str) -> str:
    seed = f"sha256('{SALT}' || {column})"
    pick = lambda pool, place: f"{q_list(pool)}[{_drawn(f'{seed} || {q(chr(58))} || {place}', 12)} % {len(pool)} + 1]"
    extra = f"len(list_filter(regexp_split_to_array({strip(column)}, '[{SPACES}]+'), lambda w: w <> '')) - 2"
    middle = f"array_to_string(list_transform(range(1, greatest({extra}, 0) + 1), lambda i: ' {joint} ' || {pick(first, 'i')}), '')"
    return f"{pick(first, '0')} || {middle} || ' ' || {pick(family, '-1')}"


def fakes() -> str:
    """CTE ``fakes``: subjects with fakes that keep the form; halves of digits shift one another ten times, one row for each turn."""
    mobile, compact = nd("mobile"), f"upper(regexp_replace({nd('iban')}, '[{SPACES}]+', '', 'g'))"
    digits = f"regexp_replace({mobile}, '[^0-9]', '', 'g')"
    inputs = " union all ".join(
        f"select '{kind}' as kind, c_custkey as k, {cut} as d from subjects where {strip(column)} <> ''" for kind, column, cut in (
            ("id", "national_id", f"substr({nd('national_id')}, 2, 8)"), ("iban", "iban", f"substr({compact}, 7)"),
            ("mobile", "mobile", f"substr({digits}, length(regexp_extract({digits}, '^[^5]*5')) + 1)")))
    shift = _drawn(f"'{SALT}:' || kind || ':10:' || n || ':' || i || ':' || b", 15)
    luhn = " + ".join(f"cast(substr('0246813579', cast(substr(body, {i}, 1) as int) + 1, 1) as int)" if i % 2 else f"cast(substr(body, {i}, 1) as int)" for i in range(1, 10))
    rest = "list_reduce(list_transform(string_split(bban || '281000', ''), lambda c: cast(c as int)), lambda a, c: (a * 10 + c) % 97, 0)"
    return f"""
turns(kind, k, n, i, a, b) as (
  select kind, k, length(d), 0, left(d, length(d) // 2), substr(d, length(d) // 2 + 1) from ({inputs})
  union all select kind, k, n, i + 1, b, lpad(cast((coalesce(try_cast(a as bigint), 0) + {shift} % m) % m as varchar), cast(w as int), '0')
  from (select *, case when i % 2 = 0 then n // 2 else n - n // 2 end as w, cast(10 ** (case when i % 2 = 0 then n // 2 else n - n // 2 end) as bigint) as m from turns where i < 10)),
permuted as materialized (select k, max(a || b) filter (where kind = 'id') as id, max(a || b) filter (where kind = 'iban') as account,
  max(a || b) filter (where kind = 'mobile') as rest from turns where i = 10 group by k),
bodies as (select s.*, left({nd('national_id')}, 1) || p.id as body, substr({compact}, 5, 2) || p.account as bban, regexp_extract({digits}, '^[^5]*5') || p.rest as numbers
  from subjects s left join permuted p on p.k = s.c_custkey),
fakes as materialized (select c_custkey, {_unless_blank('national_id', f"body || (10 - ({luhn}) % 10) % 10")} as national_id,
  {_unless_blank('mobile', _laid_out(mobile, 'numbers'))} as mobile,
  {_unless_blank('iban', _laid_out(nd('iban'), f"('SA' || lpad(cast(98 - {rest} as varchar), 2, '0') || bban)"))} as iban,
  {_unless_blank('customer_name_ar', _fake_name('customer_name_ar', V.FAKE_AR_FIRST, V.FAKE_AR_FAMILY, 'بن'))} as customer_name_ar,
  {_unless_blank('customer_name_en', _fake_name('customer_name_en', V.FAKE_EN_FIRST, V.FAKE_EN_FAMILY, 'bin'))} as customer_name_en from bodies)"""


def _developer_columns() -> str:
    """The subjects treated for testing: fakes from one table, what else is treated from another, numbered e-mails."""
    faked = ("national_id", "mobile", "iban", "customer_name_ar", "customer_name_en")
    n = "case when email_n < 1000 then lpad(cast(email_n as varchar), 3, '0') else cast(email_n as varchar) end"
    shown = {c: f"f.{c}" if c in faked else f"t.{c}" for c in COLUMNS} | {"email": _unless_blank("s.email", f"'user' || {n} || '@example.com'")}
    return (f"select c_custkey, {', '.join(f'{x} as {c}' for c, x in shown.items())} from dev_treated t join fakes f using (c_custkey) "
            f"join subjects s using (c_custkey) left join {replaced('email', '').replace('= email', '= s.email')}")


def _stream_columns() -> str:
    """The internal treatment, with names numbered first among the even keys and then among the rest."""
    names = ("customer_name_ar", "customer_name_en")
    maps = " ".join(f"""left join (select {c} as {c}_v, row_number() over (order by min(c_custkey) filter (where c_custkey % 2 = 0) is null,
      coalesce(min(c_custkey) filter (where c_custkey % 2 = 0), min(c_custkey))) as {c}_n from subjects where {strip(c)} <> '' group by {c}) {c}_map on {c}_v = s.{c}""" for c in names)
    shown = ", ".join(f"{pseudonym(c, 'Person').replace(f'({c},', f'(s.{c},').replace(f'then {c} ', f'then s.{c} ')} as {c}" if c in names else f"t.{c}" for c in COLUMNS)
    return f"select c_custkey, {shown} from int_treated t join subjects s using (c_custkey) {maps}"


QUASI = ["age", "gender", "city", "district", "job", "salary", "birth_date"]


def _subset_counts(source: str, columns: list[str]) -> str:
    """(subset, classes) for every choice of three columns."""
    return " union all ".join(
        f"select {q(', '.join(s))} as subset, count(*) as classes from (select distinct {', '.join(s)} from {source})"
        for s in combinations(columns, 3))


def visible(before: str, after: str) -> str:
    same = (f"list_sum(list_transform(range(1, least(length({before}), length({after})) + 1), "
            f"lambda i: case when substr({nd(before)}, i, 1) = substr({after}, i, 1) then 1 else 0 end))")
    return (f"case when {before} <> '' and {after} is not null then "
            f"least(1.0::double, coalesce({same}, 0) / length({before})::double) end")


WEIGHTS = {"customer_id": 0.5, "customer_name_ar": 0.7, "customer_name_en": 0.7, "national_id": 1.0, "mobile": 0.8,
           "email": 0.8, "iban": 1.0, "address_ar": 0.6, "notes": 1.0}      # notes: surest for IBANs
METHODS = {
    "external": {"customer_id": "Hashing", "customer_name_ar": "Replacement", "customer_name_en": "Replacement",
                 "national_id": "Suppression", "mobile": "Masking", "email": "Masking", "iban": "Suppression",
                 "address_ar": "Suppression", "age": "Generalization", "gender": "Keep", "city": "Generalization",
                 "district": "Suppression", "job": "Generalization", "salary": "Generalization",
                 "birth_date": "Generalization", "monthly_spending": "Keep", "customer_segment": "Keep",
                 "order_ref": "Keep", "notes": "Masking"},
}
METHODS["developer"] = METHODS["external"] | {
    "national_id": "Replacement", "mobile": "Replacement", "email": "Replacement", "iban": "Replacement",
    "address_ar": "Generalization", "city": "Keep", "district": "Generalization", "job": "Keep"}
METHODS["internal"] = METHODS["developer"] | {c: "Masking" for c in ("national_id", "mobile", "email", "iban")}
ANALYTICAL = [c for c in COLUMNS if c not in WEIGHTS]
NUMERIC = ["age", "salary", "monthly_spending", "order_ref"]


def scores(profile: str) -> str:
    """CTEs after ``treated``: exposures, quasi figures, utility factors."""
    p, methods = profile[:3], METHODS[profile]
    exposure = []
    for c, w in WEIGHTS.items():
        if c == "notes":
            e = (f"0.05::double + 0.9::double * (select case when b = 0 then 0 else least(1.0::double, a / b::double) end from "
                 f"(select (select count(*) from {p}_spans) as b, (select count(*) from {p}_l_spans) as a))")
        elif methods[c] == "Masking":
            e = f"0.1::double + 0.7::double * (select avg({visible(c + '__before', c)}) from {p}_paired)"
        else:
            e = f"{V.METHOD_EXPOSURE[methods[c]]}::double"
        exposure.append(f"select '{c}' as col, '{methods[c]}' as method, {w}::double as weight, {e} as e")
    filled = lambda suffix: ", ".join(f"coalesce({c}{suffix}, '∅') as {c}" for c in QUASI)
    removed = sum(m == "Suppression" for m in methods.values())
    cells_removed = " + ".join(f"count(*) filter (where {c} = '{V.REMOVED}')" for c in COLUMNS)

    def distribution(c):
        if methods[c] in ("Keep", "Suppression"):
            return "1.0::double" if methods[c] == "Keep" else "0.0::double"
        if c in NUMERIC:
            o, a = number(c + "__before"), midpoint(c)
            return (f"(select 1 - 0.5 * (least(1.0::double, abs(avg({a}) - avg({o})) / stddev_samp({o})) + "
                    f"least(1.0::double, abs(stddev_samp({a}) - stddev_samp({o})) / stddev_samp({o}))) from {p}_paired)")
        return (f"(select least(1.0::double, count(distinct {c}) / greatest(1, count(distinct {c}__before))::double) from {p}_paired)")

    def precision(c):
        if methods[c] == "Generalization":
            return f"(select greatest(0.0::double, 1 - {c}_width / {c}_range) from {p}_widths)"
        return "1.0::double" if methods[c] == "Keep" else "0.0::double"

    def kept_type(c):
        if methods[c] in ("Keep", "Suppression"):
            return "1.0::double" if methods[c] == "Keep" else "0.0::double"
        return "0.5::double" if c in NUMERIC else "1.0::double"
    columns = " union all ".join(
        f"select '{c}' as col, {precision(c) if c in NUMERIC else 'null::double'} as c_, {kept_type(c)} as d_, "
        f"{distribution(c)} as e_" for c in ANALYTICAL)
    return f"""
{p}_exposure as materialized ({' union all '.join(exposure)}),
{p}_q_before as materialized (select {filled('__before')} from {p}_paired),
{p}_q_after as materialized (select {filled('')} from {p}_paired),
{p}_subsets as (select avg(b) as average_before, avg(a) as average_after from (
    select b.classes / (select count(*) from subjects)::double as b, a.classes / (select count(*) from subjects)::double as a
    from ({_subset_counts(p + '_q_before', QUASI)}) b join ({_subset_counts(p + '_q_after', QUASI)}) a using (subset))),
{p}_k as (select
    (select min(n) from (select count(*) as n from {p}_q_before group by {', '.join(QUASI)})) as k_before,
    (select min(n) from (select count(*) as n from {p}_q_after group by {', '.join(QUASI)})) as k_after,
    (select count(*) from (select count(*) as n from {p}_q_before group by {', '.join(QUASI)} having count(*) = 1))
      / (select count(*) from subjects)::double as unique_before,
    (select count(*) from (select count(*) as n from {p}_q_after group by {', '.join(QUASI)} having count(*) = 1))
      / (select count(*) from subjects)::double as unique_after),
{p}_risk as materialized (select 55.0::double as direct_before,
    (select 55.0::double * sum(weight * e) / sum(weight) from {p}_exposure) as direct_after,
    45.0::double * average_before as quasi_before, 45.0::double * average_after as quasi_after, * from {p}_subsets, {p}_k),
{p}_columns as materialized ({columns}),
{p}_utility as materialized (
  select {(len(COLUMNS) - removed)} / {len(COLUMNS)}.0::double as "A",
         1 - (select ({cells_removed}) / (count(*) * {len(COLUMNS)})::double from {p}_treated) as "B",
         (select avg(c_) from {p}_columns) as "C", (select avg(d_) from {p}_columns) as "D", (select avg(e_) from {p}_columns) as "E"),
{p}_useful as (select *, 100 * (0.2 * "A" + 0.2 * "B" + 0.25 * "C" + 0.15 * "D" + 0.2 * "E") as score from {p}_utility)"""


def level(x: str) -> str:
    return f"case when {x} < 30 then 'LOW' when {x} < 60 then 'MEDIUM' else 'HIGH' end"


def r9(x: str) -> str:
    return f"round({x}, 9)"


def scored(profile: str, body: str) -> str:
    return with_(treated(profile), scores(profile)) + body


RISK_ROW = f"""select {r9('direct_before + quasi_before')} as before_exact, {r9('direct_after + quasi_after')} as after_exact,
  cast({whole('direct_before + quasi_before')} as int) as before, cast({whole('direct_after + quasi_after')} as int) as after,
  {level('direct_before + quasi_before')} as level_before, {level('direct_after + quasi_after')} as level_after,
  {", ".join(f"{r9(c)} as {c}" for c in ("direct_before", "direct_after", "quasi_before", "quasi_after"))},
  {r9('average_before')} as avg_reid_before, {r9('average_after')} as avg_reid_after, k_before, k_after,
  {r9('unique_before')} as unique_before, {r9('unique_after')} as unique_after from ext_risk"""
UTILITY_ROW = f"""select {r9('score')} as score_exact, cast({whole('score')} as int) as score,
  {", ".join(f'{r9(chr(34) + f + chr(34))} as "{f}"' for f in "ABCDE")} from ext_useful"""
MISSING = ", ".join(q(w) for w in V.MISSING_WORDS)


def as_read(column: str) -> str:
    return f"case when {column} not in ({MISSING}) then {column} end as {column}"


def all_profiles(select) -> str:
    return (with_(*[x for p in BINS for x in (treated(p), scores(p))])
            + " union all ".join(select(p, p[:3]) for p in BINS))


def subset_query() -> str:
    orders = ["o_orderstatus", "o_orderpriority", "order_year", "order_month", "price_band"]
    lines = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "ship_month"]
    total = lambda t: f"(select count(*) from {t})"
    return (f"with {CLASS_TABLES} select 'orders' as source, subset, classes, "
            f"round(classes / {total('o')}::double, 9) as average_risk from ({_subset_counts('o', orders)}) "
            f"union all select 'lineitem', subset, classes, round(classes / {total('l')}::double, 9) "
            f"from ({_subset_counts('l', lines)})")


CLASS_TABLES = """o as materialized (select o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate) as order_year,
  month(o_orderdate) as order_month, floor(o_totalprice / 50000) as price_band from orders),
l as materialized (select l_returnflag, l_linestatus, l_linenumber, cast(l_quantity as int) as l_quantity,
  strftime(l_shipdate, '%Y-%m') as ship_month from lineitem)"""


def _k_row(source: str, table: str, columns: str) -> str:
    return (f"select '{source}' as source, min(n) as k, round(count(*) filter (where n = 1) / sum(n)::double, 9) as unique_share, "
            f"cast(sum(n) as bigint) as rows, count(*) as classes from (select count(*) as n from {table} group by {columns})")


def figures(source: str, columns: dict[str, str]) -> str:
    return " union all ".join(f"select {q(c)} as column_name, {x} as x from {source}" for c, x in columns.items())


def _config_rows(profile: str) -> str:
    index = list(BINS).index(profile)
    table = ", ".join(f"({q(e)}, {q(m[index])})" for e, m in V.RECOMMENDED.items())
    order = ", ".join(f"({q(c)})" for c in COLUMNS)
    return f"""select '{profile}' as profile, c.col as "column", coalesce(d.detected, '—') as detected, d.confidence,
  coalesce(d.category, 'Non-sensitive') as category,
  case when d.first is null then 'Keep' when d.embedded then 'Masking' else r.method end as recommended
  from (values {order}) c(col) left join (
    select column_name, string_agg(entity, ', ' order by category <> 'Direct', base_risk <> 'HIGH', confidence desc, place) as detected,
           first(entity order by category <> 'Direct', base_risk <> 'HIGH', confidence desc, place) as first,
           first(category order by category <> 'Direct', base_risk <> 'HIGH', confidence desc, place) as category,
           max(confidence) as confidence, bool_or(embedded) as embedded
    from detections where flagged group by column_name) d on d.column_name = c.col
  left join (values {table}) r(entity, method) on r.entity = d.first"""


def _overridden() -> str:
    return f"""select "column", recommended, case "column" when 'mobile' then 'Suppression' when 'gender' then 'Hashing'
   else recommended end as method, case "column" when 'monthly_spending' then 'Indirect' when 'notes' then 'Non-sensitive'
   else category end as category from ({_config_rows('external')})"""


def _advice(p: str, s: str) -> str:
    other = "." if p == "external" else ", or the ''AI / External Company'' profile."
    exposed = " union all ".join(
        f"select {i} as place, case when (select {round2('e')} from {s}_exposure where col = '{c}') >= 0.5 then 'Column **{c}** is still "
        f"strongly exposed (method: {METHODS[p][c]}). Use Suppression or Replacement.' end as text" for i, c in enumerate(WEIGHTS))
    kept = ", ".join(c for c in WEIGHTS if METHODS[p][c] == "Keep")
    after = whole("direct_after + quasi_after")
    return f"""select '{p}' as profile, * from ({exposed}
  union all select 20, {q(f'Direct identifiers left unchanged: {kept}.') if kept else 'null'}
  union all select 21, case when k_after < 3 then 'Some records are still unique on the quasi-identifiers (k < 3). Consider wider generalization or suppressing one of the quasi-identifiers{other}' end from {s}_risk
  union all select 22, case when {after} >= 60 then 'Prototype risk is still HIGH – do not share this dataset externally before further anonymization.'
    when {after} >= 30 then 'Prototype risk is MEDIUM – acceptable at most for trusted internal use; review before external sharing.' end from {s}_risk
  union all select 23, case when {whole('score')} < 70 then 'Data utility dropped noticeably. If the purpose allows it, keep low-risk columns or use narrower bins.' end from {s}_useful
  union all select 24, 'Free-text columns may contain names or other details that this prototype cannot detect – review them manually.'
  union all select 25, 'Have the sharing decision reviewed by your organisation''s data-protection officer / legal team.')"""


def _report() -> str:
    """Lines of the external report as (line_no, section, text), numbered in reading order."""
    p, methods = "ext", METHODS["external"]
    quasi = ", ".join(QUASI)
    score = {x: whole(f"direct_{x} + quasi_{x}") for x in ("before", "after")}

    def fixed(x: str, digits: int) -> str:
        return f"printf('%.{digits}f', {x})"

    def names(condition: str) -> str:
        return f"(select coalesce(string_agg(column_name, ', ' order by column_name), 'none') from (select distinct column_name from detections where flagged and {condition}))"
    lines = []

    def put(section: int, *rows: str):
        """A row is SQL: a text, or a query of (text, ordering...)."""
        for row in rows:
            lines.append((section, row))
    titles = ["# Privacy Assessment Report"] + [f"## {t}" for t in V.REPORT_TITLES[1:]]
    exposed = f"(select coalesce(string_agg(col, ', '), 'none') from {p}_exposure where {round2('e')} >= 0.5)"
    bodies = [
        [q("- **Dataset:** subjects"), q("- **Date:** 2026-01-01 00:00"),
         f"'- **Number of records:** ' || format('{{:,}}', (select count(*) from subjects)) || '  |  **Columns:** {len(COLUMNS)}'",
         q("- **Sharing purpose (profile):** AI / External Company")],
        ["'- **Sensitive fields:** ' || (select count(distinct column_name) from detections where flagged)",
         "'- **Types of sensitive information:** ' || (select string_agg(label, ', ' order by label) from (select distinct label from detections where flagged))",
         q("| Column | Entity | Category | Confidence | Risk | Why it was detected |"), q("|---|---|---|---|---|---|"), None],
        [q("| Column | Category | Method |"), q("|---|---|---|"),
         *[q(f"| {c} | {'Direct' if c in WEIGHTS else 'Indirect'} | {methods[c]} |") for c in COLUMNS if methods[c] != "Keep"]],
        [f"'- **Direct identifiers detected:** ' || {names(chr(39).join(('category = ', 'Direct', '')))}",
         f"'- **Direct identifiers still strongly exposed:** ' || {exposed}",
         f"'- **Potential indirect identifiers (quasi-identifiers):** ' || {names(chr(39).join(('category = ', 'Indirect', '')))}"],
        [*[f"(select '- **{x.title()}:** ' || {score[x]} || ' / 100 (' || {level(f'direct_{x} + quasi_{x}')} || ')' from {p}_risk)" for x in ("before", "after")],
         f"(select '- Direct-identifier exposure fell from ' || {fixed('direct_before', 0)} || ' to ' || {fixed('direct_after', 0)} || "
         f"' (of 55) after treating {len(WEIGHTS)} direct-identifier column(s).' from {p}_risk)",
         f"(select '- Average re-identification probability from combinations of 3 quasi-identifiers ({quasi}) fell from ' || {fixed('average_before', 2)} "
         f"|| ' to ' || {fixed('average_after', 2)} || '; quasi part ' || {fixed('quasi_before', 0)} || ' → ' || {fixed('quasi_after', 0)} || ' (of 45).' from {p}_risk)",
         f"(select '- Records that are unique on all quasi-identifiers together: ' || {fixed('100 * unique_before', 0)} || '% → ' || {fixed('100 * unique_after', 0)} "
         f"|| '%; smallest group size (k-anonymity): ' || k_before || ' → ' || k_after || '.' from {p}_risk)"],
        [f"(select '- **Before:** 100 / 100  |  **After:** ' || {whole('score')} || ' / 100' from {p}_useful)",
         q("| Factor | Weight | Value |"), q("|---|---|---|"),
         *[f"(select '| {f}  {V.UTILITY_FACTORS[f]} | {round(100 * w)}% | ' || {fixed(f'100 * {chr(34)}{f}{chr(34)}', 0)} || '% |' from {p}_useful)"
           for f, w in V.UTILITY_WEIGHTS.items()]],
        [None], [q(V.REPORT_LINES[x]) for x in ("detection", "scores", "disclaimer")]]
    for section, (title, body) in enumerate(zip(titles, bodies)):
        put(section, q(title), q(""), *body, q(""))
    parts = []
    for place, (section, row) in enumerate(lines):
        if row is not None:
            parts.append(f"select {section} as section, {place} as place, 0 as nth, {row} as text")
        elif section == 1:
            parts.append(f"""select 1, {place}, row_number() over (order by category, column_name, d.place),
              '| ' || column_name || ' | ' || label || ' | ' || category || ' | ' || {fixed('100 * confidence', 0)} || '% | ' || risk || ' | '
              || replace(reasons, '|', '; ') || ' |' from detections d join explained x on x.col = d.column_name and x.entity = d.entity where flagged""")
        else:
            parts.append(f"select {section}, {place}, row_number() over (order by advice.place), '- ' || text from ({_advice('external', p)}) advice where text is not null")
    return ("select section, cast(row_number() over (order by place, nth) - 1 as int) as line_no, text from ("
            + " union all ".join(parts) + ")")


def _treated_columns(p: str) -> str:
    return f"select c_custkey, {', '.join(COLUMNS)} from {p}_treated"


ORACLE_SQL = {
    # sources and sinks
    "src_csv_text": with_() + f"select cast(c_custkey as varchar) as c_custkey, {', '.join(map(as_read, COLUMNS))} from subjects",
    "src_encoding_audit": with_() + "select cast(c_custkey as varchar) as c_custkey, customer_name_ar from subjects",
    "sink_csv": with_(treated("external")) + f"select cast(c_custkey as varchar) as c_custkey, {', '.join(map(as_read, COLUMNS))} from ext_treated",
    "sink_parquet": with_(treated("external")) + _treated_columns("ext"),
    # predicates and projections
    "flagged_findings": detection_query(f"select {FOUND} from detections where flagged"),
    "candidate_findings": detection_query(f"select {FOUND} from detections where not flagged and confidence >= 0.3"),
    "risk_level_of": detection_query('select column_name as "column", entity, base_risk, risk from detections'),
    "kept_direct": detection_query(
        f"""select "column", category, 'Keep' as method from ({_config_rows('internal')}) where category = 'Direct'
            and ("column" in ('email', 'customer_name_en', 'mobile') or recommended = 'Keep')"""),
    "remaining_direct": scored("internal", f"""select col as "column", method, {round2('e')} as exposure_after from (
        select col, case when kept then 'Keep' else method end as method, case when kept then 1.0::double else e end as e
        from (select *, col in ('email', 'customer_name_en') as kept from int_exposure)) where {round2('e')} >= 0.5"""),
    "changed_columns": with_(treated("external")) + " union all ".join(
        f"select '{c}' as \"column\", bool_or({c} is distinct from {c}__before) as changed from ext_paired" for c in COLUMNS),
    "preview_head": with_(treated("external")) + "select c_custkey, mobile__before, mobile, salary__before, salary, "
                                                 "city__before, city from ext_paired order by c_custkey limit 12",
    "findings_by_category": detection_query("select category, count(*) as findings, max(confidence) as highest "
                                            "from detections where flagged group by category"),
    # scalars
    "normalize_digits": with_() + "select c_custkey, " + ", ".join(
        f"{nd(c)} as {c}" for c in ("national_id", "mobile", "notes")) + " from subjects",
    "normalize_arabic": with_() + "select c_custkey, " + ", ".join(
        f"{fold(c)} as {c}" for c in ("customer_name_ar", "customer_name_en", "address_ar", "city", "notes")) + " from subjects",
    "name_tokens": with_() + "select c_custkey, " + ", ".join(
        f"array_to_string(list_filter(string_split_regex({fold(c)}, '[^\\pL\\pN]+'), lambda w: w <> ''), '|') as {c}"
        for c in ("customer_name_ar", "customer_name_en", "address_ar")) + " from subjects",
    "column_hints": with_(HINTS_CTE, cells()) + """select col as "column", entity, keyword, filled from hints
        join (select col, count(*) as filled from cells group by col) using (col)""",
    "context_keyword": with_(TEXTS, spans("texts", "x")) + f"select id, entity, s as start, {any_context()} as keyword from x_spans join texts using (id)",
    "parse_number": with_() + "select c_custkey, " + ", ".join(
        f"{number(c)} as {c}" for c in ("age", "salary", "mobile", "birth_date", "national_id")) + " from subjects",
    "band_midpoint": with_(treated("external")) + "select c_custkey, " + ", ".join(
        f"{midpoint(c)} as {c}" for c in ("age", "salary", "monthly_spending")) + " from ext_treated",
    "id_checksum_audit": with_(cells()) + f"select col as \"column\", count(*) as filled, count(*) filter (where {id_valid(nd('v'))}) as valid from cells group by col",
    "iban_checksum_audit": with_(cells()) + f"select col as \"column\", count(*) as filled, count(*) filter (where {iban_valid(nd('v'))}) as valid from cells group by col",
    "name_shape": with_(cells()) + "select k as c_custkey, col as \"column\", " + ", ".join(
        f"{x} as {n}" for n, x in name_parts("v").items()) + " from cells",
    "is_known_city": with_() + f"select c_custkey, city, {known_city('city')} as known from subjects",
    "address_keywords": with_(cells())
    + f"select k as c_custkey, col as \"column\", array_to_string(words, '|') as keywords, len(words) > 0 and length(v) >= 10 as is_address "
      f"from (select *, {keyword_hits(fold('v'))} as words from cells)",
    # spans
    **{name: with_(TEXTS, spans("texts", "x")) + f"select id, s as start, e as \"end\", frag from x_spans where entity = '{entity}'"
       for name, entity in zip(("spans_national_id", "spans_mobile", "spans_iban", "spans_email"), PATTERNS)},
    "corpus_findings": with_(TEXTS, spans("texts", "x"), f"""
judged as (select id, s, e, entity, substr(raw, s + 1, e - s) as found, {VALID} as valid, {any_context()} as keyword
           from x_spans join texts using (id)),
rated as (select *, {round2('''least(0.99::double, (case entity when 'SAUDI_NATIONAL_ID' then 0.45::double when 'SAUDI_MOBILE' then 0.6
    when 'SAUDI_IBAN' then 0.5 else 0.85 end) + (case when entity in ('SAUDI_NATIONAL_ID', 'SAUDI_IBAN') and valid then 0.15::double else 0 end)
    + (case when keyword is not null then 0.35::double else 0 end) + 0.02::double)''')} as confidence from judged)""")
    + f"""select id, s as start, e as "end", found, entity, confidence,
  case when confidence < 0.5 then '{V.NOT_FLAGGED}' when confidence < 0.7 then 'MEDIUM' else 'HIGH' end as risk,
  'Matches ' || (case entity {' '.join(f"when {q(e)} then {q(w[2])}" for e, w in V.PATTERN_WEIGHTS.items())} end) || ' pattern + '
  || (case when entity in ('SAUDI_NATIONAL_ID', 'SAUDI_IBAN') then case when valid then 'Passes checksum + ' else 'Checksum FAILS + ' end else '' end)
  || (case when keyword is null then 'No context phrase nearby' else 'Context phrase ''' || keyword || ''' next to the value' end) as reason
  from rated""",
    "resolve_overlaps": with_(TEXTS, spans("texts", "x"), kept_spans("x"))
    + "select id, sp.s as start, sp.e as \"end\", sp.entity as entity from x_kept",
    # detection
    "detect_pattern": finding_query(*PATTERNS),
    "detect_name": finding_query("PERSON_NAME", "ARABIC_PERSON_NAME"),
    "detect_address": finding_query("SAUDI_ADDRESS"),
    "detect_customer_id": finding_query("CUSTOMER_ID"),
    "detect_age": finding_query("AGE"),
    "detect_salary": finding_query("SALARY"),
    "detect_birth_date": finding_query("DATE_OF_BIRTH"),
    "detect_city": finding_query("CITY"),
    "detect_gender": finding_query("GENDER"),
    "detect_hint_only": finding_query("DISTRICT", "JOB_TITLE", "NATIONALITY"),
    "detect_table": detection_query(f"select {FOUND} from detections"),
    "explain_findings": with_(DETECTION, _explained()) + """select column_name as "column", d.entity, confidence, reasons, samples
      from detections d join explained x on x.col = d.column_name and x.entity = d.entity""",
    "dataset_summary": detection_query(f"""select (select count(*) from subjects) as records, {len(COLUMNS)}::bigint as columns,
      count(distinct column_name) filter (where flagged) as sensitive_fields,
      count(distinct column_name) filter (where flagged and category = 'Direct') as direct,
      count(distinct column_name) filter (where flagged and category = 'Indirect') as indirect,
      count(distinct column_name) filter (where flagged and risk = 'HIGH') as high_risk from detections"""),
    "findings_by_entity_risk": detection_query(
        "select label, risk, count(*) as findings from detections where flagged group by label, risk"),
    # planning
    "recommend_methods": detection_query(" union all ".join(f"({_config_rows(p)})" for p in BINS)),
    "resolve_column_entities": detection_query(
        """select column_name as "column", string_agg(entity, '|' order by category <> 'Direct', confidence desc, place) as entities,
           bool_or(embedded) as embedded from detections where flagged group by column_name"""),
    "explain_methods": detection_query(
        "select profile, p.purpose, \"column\", recommended as method, m.reason from (" + " union all ".join(f"({_config_rows(p)})" for p in BINS) + ") "
        + "join (values " + ", ".join(f"({q(k)}, {q(p.description)})" for k, p in PROFILES.items()) + ") p(profile, purpose) using (profile) "
        + "left join (values " + ", ".join(f"({q(k)}, {q(r)})" for k, r in REASONS.items()) + ") m(method, reason) on m.method = recommended"),
    "override_config": detection_query(_overridden()),
    "purpose_profiles": detection_query(
        f"""select p.*, treated, suppressed from (values
        ('external', 'AI / External Company', 'strong', 3, 0.1::double, false), ('developer', 'Developer Testing', 'medium', 8, 0.05::double, true),
        ('internal', 'Internal Analytics', 'medium', 12, 0.05::double, false)) p(profile, name, strength, target_bins, min_group_frac, format_preserving)
        join (select profile, count(*) filter (where recommended <> 'Keep') as treated, count(*) filter (where recommended = 'Suppression') as suppressed
              from ({" union all ".join(f"({_config_rows(p)})" for p in BINS)}) group by profile) using (profile)"""),
    # treatments
    "mask_generic": with_(cells()) + "select k as c_custkey, col as \"column\", " + ", ".join(
        f"{mask('v', '', s)} as {s}" for s in ("strong", "medium")) + " from cells",
    **{name: with_() + "select c_custkey, " + ", ".join(f"{mask(c, e, s)} as {s}" for s in ("strong", "medium")) + " from subjects"
       for name, c, e in (("mask_national_id", "national_id", "SAUDI_NATIONAL_ID"), ("mask_mobile", "mobile", "SAUDI_MOBILE"),
                          ("mask_iban", "iban", "SAUDI_IBAN"), ("mask_email", "email", "EMAIL_ADDRESS"))},
    "mask_person_name": with_() + "select c_custkey, " + ", ".join(
        f"{mask(c, 'PERSON_NAME', 'strong')} as {c}" for c in ("customer_name_ar", "customer_name_en")) + " from subjects",
    **{name: with_(TEXTS, spans("texts", "x"), kept_spans("x"), masked_texts("texts", "x", "medium"))
       + "select id, text from x_masked" for name in ("mask_free_text", "stream_mask")},
    "suppress": with_() + "select c_custkey, " + ", ".join(
        f"case when {c} is not null then '{V.REMOVED}' end as {c}" for c in ("national_id", "notes", "iban")) + " from subjects",
    "hash_pseudonym": with_() + "select c_custkey, " + ", ".join(
        f"'H_' || left(sha256('{SALT}' || {c}), 10) as {c}" for c in ("customer_id", "national_id", "city")) + " from subjects",
    "replace_sequential": with_() + "select c_custkey, " + ", ".join(
        f"{pseudonym(c, p)} as {c}" for c, p in (("customer_name_ar", "Person"), ("national_id", "ID"), ("job", "Value")))
    + " from subjects " + " ".join(f"left join {replaced(c, '')}" for c in ("customer_name_ar", "national_id", "job")),
    "replace_format_preserving": with_() + f"""select count(*) filter (where {strip('national_id')} <> '') as valid_ids,
      count(*) filter (where {strip('national_id')} <> '') + count(*) filter (where national_id is not null and {strip('national_id')} = '') as ids_of_same_kind,
      count(mobile) as mobiles_of_same_form, count(mobile) as mobiles_of_same_prefix, count(iban) as valid_ibans,
      count(iban) as ibans_of_same_form, count(customer_name_ar) as arabic_names, count(customer_name_en) as latin_names,
      count(customer_name_en) as names_of_same_size from subjects""",
    "replace_format_preserving_rows": with_(fakes()) + "select * from fakes",
    "choose_band_width": with_() + "select column_name as \"column\", min(x) as low, max(x) as high, " + ", ".join(
        f"{width_of('min(x)', 'max(x)', str(b))} as {p}" for p, b in BINS.items()) + f""" from (
        {figures('subjects', {c: number(c) for c in ('age', 'salary', 'monthly_spending')})}
        union all {figures('lineitem', {'l_quantity': 'l_quantity::int::double', 'l_extendedprice': 'trunc(l_extendedprice)::double'})}
        union all {figures('part', {'p_size': 'p_size::double'})}) group by column_name""",
    "generalize_numeric": with_() + f"select c_custkey, {band('age', '5::double')} as age, {band('salary', '1000::double')} as salary from subjects",
    "generalize_date": f"select o_orderkey, {year_of('d', True)} as decade, {year_of('d', False)} as year from "
                       "(select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders)",
    "generalize_city_region": with_() + f"select c_custkey, city, coalesce({region('city')}, 'Other') as region from subjects",
    "merge_rare_categories": f"select p_partkey, {merged('part', 'p_brand', 0.05)} as p_brand, {merged('part', 'p_type', 0.05)} as p_type from part",
    "generalize_address": with_() + f"select c_custkey, {address_area('address_ar')} as address_ar from subjects",
    "column_kind": with_(cells()) + f"""select col as "column", filled, numbers, dates, case when numbers / filled::double >= 0.9 then 'numeric'
      when dates / filled::double >= 0.9 then 'date' else 'text' end as kind from (select col, count(*) as filled, count({number('v')}) as numbers,
      count(*) filter (where regexp_matches(v, '^\\p{{Nd}}{{1,4}}[-/.]\\p{{Nd}}{{1,2}}[-/.]\\p{{Nd}}{{1,4}}')) as dates from cells group by col)""",
    "anonymize_table": with_(treated("external")) + _treated_columns("ext"),
    "anonymize_table_developer": with_(treated("developer"), fakes()) + _developer_columns(),
    "stream_treated": with_(treated("internal")) + _stream_columns(),
    "anonymize_table_internal": with_(treated("internal")) + _treated_columns("int"),
    # risk
    "visible_fraction": with_(treated("internal")) + " union all ".join(
        f"select '{c}' as \"column\", round(avg({visible(c + '__before', c)}), 9) as visible from int_paired"
        for c in ("national_id", "mobile", "email", "iban")),
    "residual_pii_ratio": with_(treated("external"), f"refs as (select c_custkey as id, {nd('order_ref')} as t from subjects)", spans("refs", "r"))
    + """select "column", found_before, found_after, round(case when found_before = 0 then 0 else least(1.0::double, found_after / found_before::double) end, 9) as ratio
      from (select 'notes' as "column", (select count(*) from ext_spans) as found_before, (select count(*) from ext_l_spans) as found_after
            union all select 'order_ref', (select count(*) from r_spans), (select count(*) from r_spans))""",
    "column_exposure": scored("external", f"select col as \"column\", method, weight, {round2('e')} as exposure_after from ext_exposure"),
    "direct_risk": scored("external", f"select {r9('direct_before')} as direct_before, {r9('direct_after')} as direct_after from ext_risk"),
    "quasi_risk": subset_query(),
    "k_anonymity": f"with {CLASS_TABLES} " + _k_row("orders", "o", "o_orderstatus, o_orderpriority, order_year, order_month, price_band")
    + " union all " + _k_row("lineitem", "l", "l_returnflag, l_linestatus, l_linenumber, l_quantity, ship_month"),
    "class_size_per_row": f"with {CLASS_TABLES} select o_orderkey, count(*) over (partition by o_orderstatus, o_orderpriority, order_year) as class_size from o",
    "risk_score": scored("external", RISK_ROW),
    # utility
    "columns_preserved": scored("external", f"select {r9('\"A\"')} as columns_preserved from ext_utility"),
    "cells_preserved": scored("external", f"select {r9('\"B\"')} as cells_preserved from ext_utility"),
    "numeric_precision": all_profiles(lambda p, s: f"select '{p}' as profile, col as \"column\", {round2('c_')} as numeric_precision from {s}_columns where c_ is not null"),
    "type_preservation": all_profiles(lambda p, s: f"select '{p}' as profile, col as \"column\", {round2('d_')} as type_kept from {s}_columns"),
    "numeric_distribution": all_profiles(lambda p, s: f"select '{p}' as profile, col as \"column\", {r9('e_')} as distribution from {s}_columns where col in ('age', 'salary')"),
    "category_distribution": all_profiles(lambda p, s: f"select '{p}' as profile, col as \"column\", {round2('e_')} as distribution_kept from {s}_columns where col not in ('age', 'salary')"),
    "utility_score": scored("external", UTILITY_ROW),
    # report
    "compare_profiles": all_profiles(lambda p, s: f"""select '{p}' as profile, {r9('direct_before + quasi_before')} as risk_before,
      {r9('direct_after + quasi_after')} as risk_after, {r9('score')} as utility, k_after, {level('direct_before + quasi_before')} as level_before,
      {level('direct_after + quasi_after')} as level_after from {s}_risk, {s}_useful"""),
    "recommendations": (with_(*[x for p in BINS for x in (treated(p), scores(p))])
                        + "select profile, cast(row_number() over (partition by profile order by place) - 1 as int) as line_no, text from ("
                        + " union all ".join(_advice(p, p[:3]) for p in BINS) + ") where text is not null"),
    "privacy_report": with_(DETECTION, _explained(), treated("external"), scores("external")) + _report(),
    "outcome_verdict": all_profiles(lambda p, s: f"""select '{p}' as profile, case
      when b - a >= 40 and u >= 70 then 'Privacy improved significantly (risk ' || b || ' → ' || a || ') while Data Utility remained high (' || u || '%).'
      when b > a then 'Privacy improved (risk ' || b || ' → ' || a || ', now ' || lev || ') and Data Utility is ' || u
        || '%. Try the AI / External Company profile or stronger methods for a bigger drop.'
      else 'Privacy risk did not decrease – choose stronger techniques.' end as verdict
      from (select {whole('direct_before + quasi_before')} as b, {whole('direct_after + quasi_after')} as a, {whole('score')} as u,
            {level('direct_after + quasi_after')} as lev from {s}_risk, {s}_useful)"""),
}
ORACLE_SQL["stream_findings"] = ORACLE_SQL["corpus_findings"]
