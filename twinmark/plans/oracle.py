"""DuckDB SQL of the registered queries, built from the same fixed values as the column expressions."""

from __future__ import annotations

from ..functions import vocab
from . import part_master

EMPTY = "cast([] as varchar[])"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    return f"(case when lower({strip(x)}) in ('', 'nan', 'none') then '' else {strip(x)} end)"


def normalize(x: str) -> str:
    value = f"coalesce(nullif(nullif(lower({strip(x)}), 'nan'), 'none'), '')"
    for pattern, by in (
        (r"\bm\s*[.]\s*c\s*[.]\s*b\b", "mcb"),
        ("[^a-z0-9]+", " "),
        (r"\b([a-z]+)(\d+(?:a|v|mm|cm|kg|g|l|ml|ph))\b", r"\1 \2"),
        (r"\b(\d+)\s+(a)\b", r"\1a"),
        (r"\s+", " "),
    ):
        value = f"regexp_replace({value}, '{pattern}', '{by}', 'g')"
    return f"trim({value})"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def expand(x: str) -> str:
    cases = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in vocab.ABBREVIATIONS.items())
    return rf"regexp_replace(array_to_string(list_transform({words(x)}, lambda t: case t {cases} else t end), ' '), '\bcoconut (\d+)\b', 'coconut type \1', 'g')"


def expand_apart(x: str) -> str:
    kept = {a: b for a, b in vocab.ABBREVIATIONS.items() if a not in vocab.LATER_ABBREVIATIONS}
    cases = "case t " + " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in kept.items())
    ws = words(f"trim(regexp_replace(lower({clean(x)}), '[^a-z0-9]+', ' ', 'g'))")
    parted = r"string_split(regexp_replace(regexp_replace(t, '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g'), ' ')"
    pieces = f"flatten(list_transform({ws}, lambda t: case when list_contains({listed(kept)}, t) then [t] else {parted} end))"
    return rf"regexp_replace(array_to_string(list_transform({pieces}, lambda t: {cases} else t end), ' '), '\bcoconut (\d+)\b', 'coconut type \1', 'g')"


def sorted_set(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def terms(vocabulary, w: str = "w", text: str = "ntext") -> str:
    single, phrases = [v for v in vocabulary if " " not in v], [v for v in vocabulary if " " in v]
    found = f"list_filter({listed(single)}, lambda v: list_contains({w}, v))"
    if phrases:
        found = rf"list_concat({found}, list_filter({listed(phrases)}, lambda v: regexp_matches({text}, '\b' || v || '\b')))"
    return sorted_set(found)


def matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def contexts() -> str:
    cases = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in vocab.CONTEXT_WORDS.items())
    raw = "string_split(regexp_replace(lower(coalesce(PART_NO, '')) || ' ' || lower(coalesce(DESCRIPTION, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_filter(list_transform({raw}, lambda t: case t {cases} end), lambda c: c is not null)"


def sizes(text: str) -> str:
    rest = rf"regexp_replace(regexp_replace({text}, '\bextra small\b', ' ', 'g'), '\bextra large\b', ' ', 'g')"
    found = [rf"case when regexp_matches({text}, '\b{p}\b') then '{p}' end" for p in ("extra small", "extra large")]
    found += [rf"case when regexp_matches({rest}, '\b{t}\b') then '{v}' end" for t, v in vocab.VARIANT_SIZES.items()]
    return sorted_set(f"list_filter([{', '.join(found)}], lambda x: x is not null)")


def electrical() -> str:
    values = lambda s, word, unit: rf"list_transform({matches(s, rf'\b(\d+(?:\.\d+)?)\s*{word}\b', 1)}, lambda m: m || '{unit}')"
    parts = [values(s, u.lower(), u) for s in ("ntext", "again") for u in "AV"] + [values("again", "amp", "A"), values("again", "volt", "V")]
    return sorted_set(f"flatten([{', '.join(parts)}])")


def dimensions() -> str:
    return sorted_set("flatten([" + ", ".join(rf"list_transform({matches(s, r'\b(\d+(?:\.\d+)?)\s*mm\b', 1)}, lambda m: m || 'MM')" for s in ("ntext", "again")) + "])")


MEASURE = r"\d+(mm|cm|kg|g|l|ml|v|ph|a|amp)"
measured = rf"list_filter(w2, lambda x: regexp_full_match(x, '{MEASURE}'))"
unit_of = r"regexp_extract(x, '^\d+([a-z]+)$', 1)"

VARIANTS = {
    "FILTER_FUNCTION": terms(vocab.VARIANT_FUNCTIONS, "w2", "again"),
    "COLOR": terms(vocab.VARIANT_COLORS, "w2", "again"),
    "SIZE": sizes("again"),
    "TYPE_OR_GRADE": sorted_set(matches("again", r"\b(?:type|grade)\s+[a-z0-9]+\b")),
    "ELECTRICAL_RATING": electrical(),
    "DIMENSION": dimensions(),
    "SENSOR_TYPE": terms(vocab.SENSOR_TYPES, "w2", "again"),
    "SIDE": terms(vocab.SIDES, "w2", "again"),
}
ATTRIBUTES = {
    "product_class": terms(vocab.PRODUCT_CLASSES),
    "application_context": sorted_set(f"list_concat({contexts()}, {terms(vocab.CONTEXTS)})"),
    "function_or_media": terms(vocab.FUNCTIONS_OR_MEDIA),
    "color": terms(vocab.COLORS),
    "rating": sorted_set(r"list_filter(w, lambda x: regexp_full_match(x, '\d+(a|v|mm|kg|g)'))"),
    "size": terms(vocab.SIZES),
    "volume": sorted_set(r"list_filter(w, lambda x: regexp_full_match(x, '\d+(l|ml)'))"),
    "type_code": sorted_set(matches("ntext", r"\btype\s+[a-z0-9]+\b")),
    "material": terms(vocab.MATERIALS),
    "packaging": terms(vocab.PACKAGING),
    "generic_terms": sorted_set(f"list_concat({terms(vocab.GENERIC_TERMS)}, case when list_contains(w, 'labels') then ['label'] else {EMPTY} end)"),
}
TECHNICAL = {
    "numbers": sorted_set(rf"list_concat(list_transform({measured}, lambda x: regexp_extract(x, '^(\d+)', 1)), list_filter(w2, lambda x: regexp_full_match(x, '\d+')))"),
    "measurements": sorted_set(rf"list_transform({measured}, lambda x: regexp_extract(x, '^(\d+)', 1) || case when {unit_of} in ('a', 'amp') then 'amp' else {unit_of} end)"),
    "dimensions": matches("again", r"\b\d+\s*x\s*\d+(?:\s*x\s*\d+)?\b"),
    "modifiers": terms(vocab.MODIFIERS, "w2", "again"),
    "units": sorted_set(rf"list_concat(list_transform(list_filter(w2, lambda x: regexp_full_match(x, '\d+[a-z]+')), lambda x: {unit_of}), list_filter({listed(vocab.UNITS)}, lambda v: list_contains(w2, v)))"),
}
FAMILY = (
    "case when list_contains(wd, 'filter') then 'filters' when list_contains(wd, 'paint') then 'paint items' when list_contains(wd, 'coconut') then 'coconut items' "
    "when list_contains(wd, 'sensor') then 'sensors' when list_contains(wd, 'mcb') or (list_contains(wd, 'miniature') and list_contains(wd, 'circuit') and list_contains(wd, 'breaker')) then 'MCB items' "
    "when list_contains(wd, 'pipe') then 'pipe items' else 'items' end"
)
GENERIC = f"(len(wd) between 1 and 2 and len(list_filter(wd, lambda x: not list_contains({listed(vocab.GENERIC_TERMS)}, x))) = 0)"

def records(view: str) -> str:
    """CTEs that end in ``rec``: the records of a view with all that pairs need."""
    return f"""
pm as ({view}),
n1 as (select *, {normalize('PART_NO')} as n_part, {normalize('DESCRIPTION')} as n_desc, {normalize('MASTER_PART_DESCRIPTION')} as n_master from pm),
n2 as (select *, {expand('n_part')} as npart, {expand('n_desc')} as ndesc0, {expand('n_master')} as nmaster from n1),
n3 as (select *, concat_ws(' ', nullif(ndesc0, ''), nullif(nmaster, '')) as ndesc from n2),
n4 as (select *, concat_ws(' ', nullif(npart, ''), nullif(ndesc, '')) as ntext from n3),
n5 as (select *, {normalize('ntext')} as n_text from n4),
n6 as (select *, {expand('n_text')} as again from n5),
n7 as (select *, {words('ntext')} as w, {words('again')} as w2, {words('ndesc0')} as wd from n6),
rec as (select *, {', '.join(f'{e} as at_{n}' for n, e in ATTRIBUTES.items())}, {', '.join(f'{e} as {n}' for n, e in TECHNICAL.items())},
 {', '.join(f'{e} as v_{n}' for n, e in VARIANTS.items())}, list_sort(list_distinct({contexts()})) as raw_context, {GENERIC} as is_generic, {FAMILY} as family from n7)
"""


RECORDS = records(part_master.duckdb_view())


def important(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: length(t) >= {vocab.TOKEN_LENGTH} and not list_contains({listed(vocab.LOW_VALUE_TOKENS)}, t))"


def value(f: str, row: str = "") -> str:
    return f"lower({strip(row + f)})"


def block_list(fields) -> str:
    parts = []
    if fields:
        every = " and ".join(f"{value(f)} <> ''" for f in fields)
        parts.append(f"case when {every} then ['selected:' || {' || chr(31) || '.join(value(f) for f in fields)}] else {EMPTY} end")
    parts.append(f"list_transform({important('ndesc')}, lambda t: 'desc:' || t)")
    parts.append(f"list_transform({important('npart')}, lambda t: 'part:' || t)")
    parts += [f"list_transform(at_{a}, lambda t: 'attr:{a}:' || t)" for a in vocab.BLOCK_ATTRIBUTES]
    return f"flatten([{', '.join(parts)}])"


def pair_tables(fields, cross_site: bool = False, cap: int | None = None) -> str:
    scope = list(fields) + ([] if cross_site or "CONTRACT" in fields else ["CONTRACT"])
    fits = " and ".join(f"(a.f{k} = '' or b.f{k} = '' or a.f{k} = b.f{k})" for k, _ in enumerate(scope)) or "true"
    picked = ", ".join(f"{value(f)} as f{k}" for k, f in enumerate(scope)) + ", " if scope else ""
    blocks = f"""
bl0 as (select rec_idx, {value('PART_NO')} as p, {picked} {block_list(fields)} as ks from rec),
bl1 as (select * exclude (ks), unnest(ks) as key, generate_subscripts(ks, 1) as pos from bl0),
bl as (select rec_idx, p, {''.join(f'f{k}, ' for k, _ in enumerate(scope))} key, min(pos) as pos from bl1 group by all),
shared as (select a.rec_idx as idx_a, b.rec_idx as idx_b, a.key from bl a join bl b on a.key = b.key and a.rec_idx < b.rec_idx
  and (a.p = '' or a.p <> b.p) and {fits})"""
    rows = "shared"
    if cap is not None:
        blocks += f""",
ord as (select key, arg_min(pos, (rec_idx, pos)) as o_pos, min(rec_idx) as o_rec from bl group by key),
placed as (select shared.*, (o_rec, o_pos, idx_a, idx_b) as place from shared join ord using (key)),
firsts as (select idx_a, idx_b, min(place) as place from placed group by 1, 2),
edge as (select max(place) as place, count(*) as n from (select place from firsts order by place limit {cap})),
seen as (select placed.* exclude (place) from placed, edge where placed.place <= edge.place or edge.n < {cap})"""
        rows = "seen"
    reasons = "case split_part(key, ':', 1) when 'selected' then 'selected_fields_match' when 'desc' then 'normalized_description_token_match' when 'part' then 'normalized_part_number_token_match' else 'extracted_attribute_match' end"
    return blocks + f""",
prs as (select idx_a, idx_b, {joined(f'list_sort(list_distinct(list({reasons})))')} as candidate_reasons, {joined('list_sort(list_distinct(list(key)))')} as matched_blocks
  from {rows} group by 1, 2)"""


def both(pairs: str = "prs") -> str:
    return f"{pairs} join rec a on a.rec_idx = {pairs}.idx_a join rec b on b.rec_idx = {pairs}.idx_b"


def round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def overlap(a: str, b: str) -> str:
    both_sets = f"len(list_filter(list_distinct({a}), lambda x: list_contains({b}, x)))"
    return f"({both_sets} / len(list_distinct(list_concat({a}, {b}))))"


def some(a: str, b: str) -> str:
    return f"(len({a}) > 0 or len({b}) > 0)"


def full(a: str, b: str) -> str:
    return f"(len({a}) > 0 and len({b}) > 0)"


def technical_score() -> str:
    weight = " + ".join(f"case when {some(f'a.{k}', f'b.{k}')} then {w}.0::double else 0 end" for k, w in vocab.TECHNICAL_WEIGHTS.items())
    total = " + ".join(f"case when {full(f'a.{k}', f'b.{k}')} then {w} * {overlap(f'a.{k}', f'b.{k}')} else 0 end" for k, w in vocab.TECHNICAL_WEIGHTS.items())
    return f"case when {weight} = 0 then 50.0::double else {round2(f'({total}) / ({weight}) * 100')} end"


def structured_score() -> str:
    count = " + ".join(f"case when {some(f'a.at_{k}', f'b.at_{k}')} then 1 else 0 end" for k in vocab.FEATURES)
    total = " + ".join(f"case when {full(f'a.at_{k}', f'b.at_{k}')} then {overlap(f'a.at_{k}', f'b.at_{k}')} else 0 end" for k in vocab.FEATURES)
    return f"case when {count} = 0 then 50.0::double else {round2(f'({total}) / ({count}) * 100')} end"


def field_lists(fields) -> tuple[str, str]:
    pick = lambda sign: "list_filter([" + ", ".join(f"case when {value(f, 'a.')} <> '' and {value(f, 'b.')} <> '' and {value(f, 'a.')} {sign} {value(f, 'b.')} then '{f}' end" for f in fields) + "], lambda x: x is not null)"
    return pick("="), pick("<>")


def business_score(fields) -> str:
    m, u = (f"len({x})" for x in field_lists(fields))
    return f"case when {m} + {u} = 0 then 50.0::double else {m} / ({m} + {u}) * 100 end"


def differs(f: str) -> str:
    return f"({clean('a.' + f)} <> '' and {clean('b.' + f)} <> '' and lower({clean('a.' + f)}) <> lower({clean('b.' + f)}))"


def set_differs(n: str) -> str:
    return f"({full(f'a.{n}', f'b.{n}')} and list_sort(a.{n}) <> list_sort(b.{n}))"


def guard_rules(mode: str) -> list[tuple]:
    """(condition, status, rule decision, reason, score, text) of the classic guards, in order; ``a`` and ``b`` are the records."""
    rules = [(f"{clean('a.PART_NO')} <> '' and lower({clean('a.PART_NO')}) = lower({clean('b.PART_NO')})", vocab.UNIQUE, "REJECT", "'SAME_PART_NO'", 0, "'Same PART_NO detected. This is the same part reference, not a duplicate candidate.'")]
    for f, label, rule, score in vocab.HARD_FIELDS:
        text = f"'{label} differs ({f} differs: ' || {clean('a.' + f)} || ' vs ' || {clean('b.' + f)} || '), so this cannot be treated as a confirmed duplicate.'"
        rules.append((differs(f), vocab.CONFLICT, rule, f"'{f}_MISMATCH'", score, text))
    if mode == vocab.SCAN_MODES[0]:
        rules.append((differs("CONTRACT"), vocab.UNIQUE, "REJECT", "'CONTRACT_MISMATCH_IN_SAME_SITE_MODE'", 55, "'Different site detected in same-site duplicate mode. This is not a normal same-site duplicate.'"))
    else:
        rules.append((differs("CONTRACT"), vocab.CROSS_SITE, "CROSS_SITE", "'CONTRACT_MISMATCH'", 78, "'Same or similar item appears across different sites and should be reviewed for standardization.'"))
    for g, label in vocab.VARIANT_LABELS.items():
        v = f"v_{g}"
        text = f"'Both are ' || case when a.family = b.family then a.family else 'items' end || ', but {label} differs: ' || array_to_string(a.{v}, ', ') || ' vs ' || array_to_string(b.{v}, ', ') || '.'"
        rules.append((set_differs(v), vocab.RELATED, "DOWNGRADE", f"'{g}_MISMATCH'", 55, text))
    return rules


def classic_guards(mode: str = vocab.SCAN_MODES[0]) -> str:
    rules = guard_rules(mode)
    case = lambda k, fmt: "case " + " ".join(f"when {r[0]} then {fmt(r[k])}" for r in rules) + " end"
    return (
        f"select idx_a, idx_b, {case(1, quoted)} as status, {case(2, quoted)} as rule_decision, {case(3, str)} as rejection_reason, "
        f"{case(4, lambda x: f'{float(x)}::double')} as score, {case(5, str)} as explanation from {both()}"
    )


def evidence_guards(cross_site: bool = False) -> str:
    hard = [(set_differs(f"at_{n}"), f"{n}_mismatch") for n in ("rating", "color", "type_code", "function_or_media")]
    data = [(differs("HSN_SAC_CODE"), "hsn_sac_mismatch"), (differs("HAZARD_CODE"), "safety_code_mismatch")]
    warn = [(set_differs("at_application_context"), "application_context_mismatch"), ("(a.is_generic or b.is_generic)", "generic_or_sparse_description")]
    site = (differs("CONTRACT"), "cross_site_candidate" if cross_site else "contract_scope_mismatch")
    (warn if cross_site else hard).append(site)
    pick = lambda rows: joined("list_sort(list_filter([" + ", ".join(f"case when {c} then '{k}' end" for c, k in rows) + "], lambda x: x is not null))")
    flags = " or ".join(c for c, _ in data)
    return f"select idx_a, idx_b, {pick(hard + data)} as conflict_types, {pick(warn)} as warning_types, ({flags}) as data_conflict from {both()}"


def similarity_words(x: str) -> str:
    return rf"array_to_string(list_transform({words(x)}, lambda t: case when t = 'mcb' then 'mcb miniature circuit breaker' when regexp_full_match(t, '\d+a') then t || ' ' || regexp_replace(t, 'a$', '') || ' amp' else t end), ' ')"


def gram_cosine(texts: str, name: str = "cosines") -> str:
    """CTEs that give ``name`` (ta, tb, tfidf_score) for a table expression with distinct ta, tb."""
    n = name
    cosine = round2("coalesce(100 * dot / sqrt((own_a + (sa.s - own_a) * power(1 + ln(1.5), 2)) * (own_b + (sb.s - own_b) * power(1 + ln(1.5), 2))), 0)")
    return f"""
{n}_tp as ({texts}),
{n}_tt as (select distinct t from (select ta as t from {n}_tp union all select tb from {n}_tp)),
{n}_tw as (select t, unnest({words('t')}) as word from {n}_tt),
{n}_pd as (select t, ' ' || word || ' ' as p from {n}_tw),
{n}_gr as (select t, unnest(flatten([[substr(p, k, n) for k in range(1, greatest(length(p) - n, 0) + 2)] for n in [3, 4, 5] if n = 3 or length(p) > n - 1])) as g from {n}_pd),
{n}_gc as (select t, g, count(*) as c from {n}_gr group by 1, 2),
{n}_dots as (select ta, tb, sum(x.c * y.c) as dot, sum(x.c * x.c) as own_a, sum(y.c * y.c) as own_b
  from {n}_tp join {n}_gc x on x.t = ta join {n}_gc y on y.t = tb and y.g = x.g group by 1, 2),
{n}_sq as (select t, sum(c * c) as s from {n}_gc group by 1),
{n} as (select p.ta, p.tb, {cosine} as tfidf_score
  from {n}_tp p left join {n}_dots d on d.ta = p.ta and d.tb = p.tb left join {n}_sq sa on sa.t = p.ta left join {n}_sq sb on sb.t = p.tb)"""


def common_length(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, row by row."""
    inner = f"list_reduce(range(1, length({a}) + 1), lambda nr, j: list_append(nr, case when substr({a}, j, 1) = substr({b}, i, 1) then prev[j] + 1 else greatest(prev[j + 1], nr[j]) end), [0::bigint])"
    return f"list_last(list_reduce(range(1, length({b}) + 1), lambda prev, i: {inner}, list_transform(range(length({a}) + 1), lambda z: 0::bigint)))"


def groups(found: str, minimum: float) -> str:
    """Groups over a table expression with idx_a, idx_b, node_a, node_b, similarity_score, level."""
    return f"""
adm as (select * from {found} where similarity_score >= {minimum} and level in ('HIGH', 'MEDIUM')),
lk as (select node_a as x, node_b as y from adm union select node_b, node_a from adm),
nd as (select distinct x as n from lk),
reach(n, m) as (select n, n from nd union select lk.y, reach.m from reach join lk on lk.x = reach.n),
comp as (select n, min(m) as c from reach group by n)"""


#: Columns that every view of records has.
RECORD_COLUMNS = ("PART_NO", "DESCRIPTION", "MASTER_PART_DESCRIPTION", "CONTRACT", "HSN_SAC_CODE", "UNIT_MEAS", "PRODUCT_CATEGORY_ID", "HAZARD_CODE")


def synthetic(count: str, duplicate_rate: float = 0.15, variation_rate: float = 0.3, seed: int = 1) -> str:
    """The made-up records, by the same digests."""
    draw = lambda k: f"(('0x' || substr(md5('{seed + k}:' || i), 1, 8))::bigint / 4294967296.0::double)"
    options = ", ".join(f"({k}, " + ", ".join(map(quoted, row)) + ")" for k, row in enumerate(vocab.SYNTHETIC))
    return f"""select i as rec_idx, case when {draw(2)} < 0.5 then 'SITE-A' else 'SITE-B' end as CONTRACT, p || '-' || lpad(i::varchar, 5, '0') as PART_NO,
 case when {draw(1)} < {1 - (1 - variation_rate) * (1 - duplicate_rate)}::double then v else c end as DESCRIPTION, 'P' as TYPE_CODE, u as UNIT_MEAS, m as PRIME_COMMODITY, '' as SECOND_COMMODITY, '' as HAZARD_CODE, 'INV' as ACCOUNTING_GROUP,
 m as PART_PRODUCT_CODE, m as PART_PRODUCT_FAMILY, m as PRODUCT_CATEGORY_ID, '' as HSN_SAC_CODE
 from (select unnest(range(({count}))) as i) join (values {options}) t(k, p, c, v, u, m) on k = floor({draw(0)} * {len(vocab.SYNTHETIC)})"""


def labelled_pairs(view: str, cut: float = 60.0) -> str:
    """CTEs that end in ``scored``: neighbouring records of a view as labelled pairs, scored by the classic engine."""
    others = ", ".join(f"cast(null as varchar) as {c}" for c in RECORD_COLUMNS[2:])
    sides = " union all ".join(f"select pair_id * 2 + {k} as rec_idx, '{s.upper()}' as PART_NO, description_{s} as DESCRIPTION, {others} from lp" for k, s in enumerate("ab"))
    return f"""with src as ({view}), lp as (select a.rec_idx as pair_id, a.DESCRIPTION as description_a, b.DESCRIPTION as description_b, cast(a.rec_idx % 3 = 0 as int) as expected_label
  from src a join src b on b.rec_idx = a.rec_idx + 1 where a.rec_idx % 2 = 1), {records(sides)},
 prs as (select pair_id * 2 as idx_a, pair_id * 2 + 1 as idx_b from lp), {classic_decisions(())},
 scored as (select lp.*, similarity_score as score, cast(similarity_score >= {cut} as int) as guess from lp join decided on idx_a = pair_id * 2)"""


#: Letters of normalised texts, for bit rows of the common subsequence.
LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789"


def bit_rows(x: str) -> str:
    """For each letter the bit set of its places in a normalised text of at most 125 letters."""
    here = f"list_filter(range(1, length({x}) + 1), lambda k: substr({x}, k, 1) = substr('{LETTERS}', c, 1))"
    return f"list_transform(range(1, {len(LETTERS) + 1}), lambda c: list_reduce(list_transform({here}, lambda k: 1::hugeint << (k - 1)::integer), lambda p, q: p | q, 0::hugeint))"


def letter_codes(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda k: instr('{LETTERS}', substr({x}, k, 1)))"


def common_bits(rows: str, length: str, codes: str) -> str:
    """Length of the longest common subsequence of a text given by its bit rows and another given by its letter codes."""
    full = f"((1::hugeint << ({length})::integer) - 1)"
    return f"(({length}) - bit_count(list_reduce({codes}, lambda r, k: ((r + (r & {rows}[k])) | (r - (r & {rows}[k]))) & {full}, {full})))"


def fuzzy_scores(texts: str, name: str = "fz") -> str:
    """CTEs that give ``name`` (ta, tb, fuzzy_score) for a table expression with distinct ta, tb: 0.6 token-set + 0.4 partial ratio."""
    n = name
    return f"""
{n}_p as ({texts}),
{n}_t as (select t, length(t) as n, {bit_rows('t')} as m, {letter_codes('t')} as c, {sorted_set(words('t'))} as ks
  from (select distinct t from (select ta as t from {n}_p union all select tb from {n}_p))),
{n}_k as (select ta, tb, x.ks as ka, y.ks as kb, list_filter(x.ks, lambda w: list_contains(y.ks, w)) as common,
  list_filter(x.ks, lambda w: not list_contains(y.ks, w)) as oa, list_filter(y.ks, lambda w: not list_contains(x.ks, w)) as ob
  from {n}_p join {n}_t x on x.t = ta join {n}_t y on y.t = tb),
{n}_s as (select *, length(array_to_string(common, ' ')) as shared, array_to_string(list_concat(common, oa), ' ') as one, array_to_string(list_concat(common, ob), ' ') as two from {n}_k),
{n}_r as (select *, {bit_rows('one')} as m1, {letter_codes('two')} as c2 from {n}_s),
{n}_set as (select ta, tb, case when len(ka) = 0 or len(kb) = 0 then 0.0::double when len(common) > 0 and (len(oa) = 0 or len(ob) = 0) then 100.0::double
  else greatest(case when len(common) > 0 then greatest(200.0::double * shared / (shared + length(one)), 200.0::double * shared / (shared + length(two))) else 0.0::double end,
   200.0::double * {common_bits('m1', 'length(one)', 'c2')} / (length(one) + length(two))) end as s from {n}_r),
{n}_d as (select ta, tb, case when length(ta) <= length(tb) then ta else tb end as short, case when length(ta) <= length(tb) then tb else ta end as long from {n}_p
  union all select ta, tb, tb, ta from {n}_p where length(ta) = length(tb)),
{n}_w as (select ta, tb, x.m, x.n, y.c[greatest(0, e - x.n) + 1 : least(e, y.n)] as w
  from (select ta, tb, short, long, unnest(range(1, length(long) + length(short))) as e from {n}_d) join {n}_t x on x.t = short join {n}_t y on y.t = long),
{n}_part as (select ta, tb, max(200.0::double * {common_bits('m', 'n', 'w')} / (n + len(w))) as s from {n}_w group by ta, tb),
{n} as (select p.ta, p.tb, {round2('0.6::double * s.s + 0.4::double * coalesce(w.s, 0)')} as fuzzy_score
  from {n}_p p join {n}_set s on s.ta = p.ta and s.tb = p.tb left join {n}_part w on w.ta = p.ta and w.tb = p.tb)"""


def string_scores(pairs: str, name: str, text: str) -> str:
    """CTEs that give ``name`` (idx_a, idx_b, tfidf, fuzzy, part_score) of pairs of records, by a text expression over ``rec``."""
    n = name
    distinct = f"select distinct ta, tb from {n}_x where ta <> '' and tb <> ''"
    part = round2(f"200.0::double * {common_bits('pm', 'length(pa)', 'pc')} / (length(pa) + length(pb))")
    return f"""
{n}_t as (select rec_idx, {text} as t, replace(npart, ' ', '') as bare from rec),
{n}_x as (select idx_a, idx_b, a.t as ta, b.t as tb, a.bare as pa, b.bare as pb from {pairs} join {n}_t a on a.rec_idx = idx_a join {n}_t b on b.rec_idx = idx_b),
{gram_cosine(distinct, n + '_g')},
{fuzzy_scores(distinct, n + '_f')},
{n}_m as (select *, {bit_rows('pa')} as pm, {letter_codes('pb')} as pc from {n}_x),
{n} as (select m.idx_a, m.idx_b, coalesce(g.tfidf_score, 0) as tfidf, coalesce(f.fuzzy_score, 0) as fuzzy, case when pa = '' or pb = '' then 0.0::double else {part} end as part_score
  from {n}_m m left join {n}_g g on g.ta = m.ta and g.tb = m.tb left join {n}_f f on f.ta = m.ta and f.tb = m.tb)"""


def blended(tfidf: str, fuzzy: str) -> str:
    return round2(f"{tfidf} * 0.6::double + {fuzzy} * 0.4::double")


def clamped(x: str) -> str:
    return round2(f"greatest(0.0::double, least(100.0::double, {x}))")


def level(x: str) -> str:
    return "case " + " ".join(f"when {x} >= {least} then '{name}'" for name, least in vocab.LEVELS) + " else 'IGNORE' end"


def list_of(*items: str) -> str:
    """The items that are not null."""
    return f"list_filter([{', '.join(items)}], lambda x: x is not null)"


def warned(messages: str) -> str:
    text = f"lower({joined(messages)})"
    return f"(contains({text}, 'generic') or contains({text}, 'sparse')) as generic_warning, contains({text}, 'application context') as context_warning"


def classic_decisions(fields, mode: str = vocab.SCAN_MODES[0], pairs: str = "prs") -> str:
    """CTEs that give ``decided``, the pairs as the classic engine decides them."""
    rules = guard_rules(mode)
    number = "case " + " ".join(f"when {r[0]} then {k}" for k, r in enumerate(rules)) + " end"
    pick = lambda k, fmt=quoted: "case guard " + " ".join(f"when {i} then {fmt(r[k])}" for i, r in enumerate(rules)) + " end"
    matched, mismatched = field_lists(fields)
    site = len(vocab.HARD_FIELDS) + 1
    variants = list_of(*[f"case when {set_differs(f'v_{g}')} then '{g}' end" for g in vocab.VARIANT_LABELS])
    hard = " ".join(f"when guard = {k} then ['{f}']" for k, (f, *_) in enumerate(vocab.HARD_FIELDS, 1))
    found = f"case when guard = 0 then {EMPTY} {hard} when guard = {site} then ['CONTRACT'] when guard > {site} then {variants} end"
    context = "(len(a.raw_context) > 0 and len(b.raw_context) > 0 and a.raw_context <> b.raw_context)"
    action = "case " + " ".join(f"when confidence_level = '{k}' then {quoted(v)}" for k, v in vocab.LEVEL_ACTIONS.items()) + " end"
    context_text = "case when context then 'Application context appears different: ' || array_to_string(ca, ', ') || ' vs ' || array_to_string(cb, ', ') || '.' end"
    generic_text = "case when generic then 'One description is too generic to confirm duplicate identity.' end"
    body = (
        "case when description_similarity >= 80 and part_no_similarity >= 90 then 'Descriptions and part numbers match after business synonym normalization.' "
        "when description_similarity >= 85 and len(mf) > 0 then 'Descriptions are highly similar and selected business fields match.' "
        "when len(mf) > 0 then 'Descriptions show meaningful similarity and ' || len(mf) || ' selected business field(s) match.' "
        "else 'Candidate is based mainly on description, part number, and technical token similarity.' end"
    )
    total = "description_similarity * 0.6::double + business * 0.2::double + part_no_similarity * 0.1::double + technical * 0.1::double"
    return f"""
c0 as (select idx_a, idx_b, {number} as guard from {both(pairs)}),
c1 as (select idx_a, idx_b, guard, {matched} as mf, {mismatched} as mm, {technical_score()} as technical, {business_score(fields)} as business,
  (a.is_generic <> b.is_generic) as generic, {context} as context, a.raw_context as ca, b.raw_context as cb, {pick(5, str)} as guard_text, {found} as kinds from {both('c0')}),
c2 as (select idx_a, idx_b from c1 where guard is null),
{string_scores('c2', 'cs', similarity_words('ndesc0'))},
c3 as (select c1.*, tfidf as tfidf_score, fuzzy as fuzzy_score, part_score as part_no_similarity, {blended('tfidf', 'fuzzy')} as description_similarity
  from c1 join cs on cs.idx_a = c1.idx_a and cs.idx_b = c1.idx_b),
c4 as (select *, {clamped(total)} as raw from c3),
c5 as (select idx_a, idx_b, least(raw, case when generic then 65.0::double else 100.0::double end, case when context then 78.0::double else 100.0::double end) as similarity_score,
  description_similarity, tfidf_score, fuzzy_score, part_no_similarity, technical as technical_token_score,
  case when context then '{vocab.POSSIBLE}' when generic then '{vocab.INSUFFICIENT}' when raw >= 85 then '{vocab.DUPLICATE}' when raw >= 60 then '{vocab.POSSIBLE}' else '{vocab.UNIQUE}' end as business_status,
  case when context or generic then 'DOWNGRADE' else 'ALLOW' end as rule_decision, case when context then 'APPLICATION_CONTEXT_MISMATCH' when generic then 'GENERIC_DESCRIPTION' else '' end as rejection_reason,
  concat_ws(' ', {body}, {generic_text}, {context_text}) as explanation, mf, mm, case when context then ['APPLICATION_CONTEXT'] else {EMPTY} end as kinds, {list_of(generic_text, context_text)} as messages from c4
 union all select idx_a, idx_b, {pick(4, lambda x: f'{float(x)}::double')}, 0.0, 0.0, 0.0, 0.0, 0.0, {pick(1)}, {pick(2)}, {pick(3, str)}, guard_text, mf, mm, kinds, {EMPTY} from c1 where guard is not null),
c6 as (select *, {level('similarity_score')} as confidence_level from c5),
decided as (select idx_a, idx_b, similarity_score, confidence_level, description_similarity, tfidf_score, fuzzy_score, part_no_similarity, technical_token_score, business_status, rule_decision, rejection_reason,
  {action} as recommended_action, explanation, {joined('mf')} as matched_fields, {joined('mm')} as mismatched_fields, {joined('mf')} as matched_evidence, {joined('kinds')} as difference_kinds, {joined('messages')} as warnings,
  {warned('messages')} from c6)"""


def evidence_findings(cross_site: bool) -> list[tuple[str, str, str]]:
    """(condition, kind, message) of the findings, in order."""
    labels = {"rating": "Rating", "color": "Color", "type_code": "Type code", "function_or_media": "Function or media"}
    site = (
        (differs("CONTRACT"), "cross_site_candidate", "Candidate spans different sites and should be reviewed as a cross-site standardization case.")
        if cross_site
        else (differs("CONTRACT"), "contract_scope_mismatch", "Candidate spans different sites while cross-site matching is disabled.")
    )
    return [
        *[(set_differs(f"at_{n}"), f"{n}_mismatch", f"{label} differs between the two candidate records.") for n, label in labels.items()],
        (set_differs("at_application_context"), "application_context_mismatch", "Application context differs and should be manually reviewed."),
        ("(a.is_generic or b.is_generic)", "generic_or_sparse_description", "One description is too generic or sparse to confirm duplicate identity."),
        (differs("HSN_SAC_CODE"), "hsn_sac_mismatch", "HSN/SAC Code differs between candidate records."),
        (differs("HAZARD_CODE"), "safety_code_mismatch", "Safety code differs between candidate records."),
        site,
    ]


#: Findings that are warnings and no conflicts.
SOFT = ("application_context_mismatch", "generic_or_sparse_description", "cross_site_candidate")
#: Outcome, status, rule decision, SQL of the reason.
OUTCOMES = (
    ("DATA", vocab.CONFLICT, "DATA_CONFLICT", "array_to_string(conflicts, ',')"),
    ("DIFF", vocab.RELATED, "REJECT_BY_DIFFERENTIATOR", "array_to_string(differing, ',')"),
    ("CROSS", vocab.CROSS_SITE, "CROSS_SITE_REVIEW", "'CONTRACT_MISMATCH'"),
    ("SCOPE", vocab.UNIQUE, "SCOPE_REJECT", "'CONTRACT_MISMATCH'"),
    ("GENERIC_HIGH", vocab.POSSIBLE, "GENERIC_REVIEW", "'GENERIC_OR_SPARSE_DESCRIPTION'"),
    ("GENERIC", vocab.INSUFFICIENT, "GENERIC_REVIEW", "'GENERIC_OR_SPARSE_DESCRIPTION'"),
    ("HIGH", vocab.DUPLICATE, "ALLOW", "''"),
    ("MIDDLE", vocab.POSSIBLE, "ALLOW", "''"),
    ("LOW", vocab.UNIQUE, "LOW_SIMILARITY", "''"),
)


def evidence_decisions(fields, cross_site: bool = False, pairs: str = "prs") -> str:
    """CTEs that give ``decided``, the pairs as the evidence engine decides them."""
    matched, mismatched = field_lists(fields)
    found = evidence_findings(cross_site)
    same = lambda n: f"({full(f'a.at_{n}', f'b.at_{n}')} and a.at_{n} = b.at_{n})"
    kinds = lambda want: list_of(*[f"case when {c} then '{k}' end" for c, k, _ in found if want(k)])
    messages = list_of(*[f"case when {c} then {quoted(m)} end" for c, _, m in found])
    same_features = list_of(*[f"case when {same(n)} then '{n}' end" for n in vocab.FEATURES])
    unequal = list_of(*[f"case when {set_differs(f'at_{n}')} then '{n}' end" for n in vocab.FEATURES])
    tagged = lambda x: f"list_transform({x}, lambda f: 'field:' || f)"
    commas = lambda x: f"array_to_string(list_filter({x}, lambda v: v <> ''), ', ')"
    shared = lambda n: commas(f"list_sort(list_filter(a.at_{n}, lambda v: list_contains(b.at_{n}, v)))")
    versus = lambda n: f"{commas(f'a.at_{n}')} || ' vs ' || {commas(f'b.at_{n}')}"
    has = lambda k: f"list_contains(conflicts, '{k}')"
    choose = lambda k, fmt=quoted: "case outcome " + " ".join(f"when '{o[0]}' then {fmt(o[k])}" for o in OUTCOMES) + " end"
    action = "case " + " ".join(f"when business_status = '{k}' then {quoted(v)}" for k, v in vocab.STATUS_ACTIONS.items())
    total = "greatest(description_similarity, master) * 0.45::double + part_no_similarity * 0.20::double + structured * 0.25::double + technical * 0.10::double"
    generic = "list_contains(soft, 'generic_or_sparse_description')"
    return f"""
{string_scores(pairs, 'es', similarity_words(expand(normalize('ndesc'))))},
{string_scores(pairs, 'em', similarity_words('nmaster'))},
e0 as (select es.idx_a, es.idx_b, es.tfidf as tfidf_score, es.fuzzy as fuzzy_score, es.part_score as part_no_similarity, {blended('es.tfidf', 'es.fuzzy')} as description_similarity,
  {blended('em.tfidf', 'em.fuzzy')} as master from es join em on em.idx_a = es.idx_a and em.idx_b = es.idx_b),
e1 as (select e0.*, {technical_score()} as technical, {structured_score()} as structured, {matched} as mf, {mismatched} as mm,
  list_sort({kinds(lambda k: k not in SOFT)}) as conflicts, list_sort({kinds(lambda k: k in SOFT)}) as soft, {kinds(lambda k: True)} as all_kinds, {messages} as messages,
  {same_features} as same_features, {unequal} as unequal, {differs('CONTRACT')} as sites_differ from {both('e0')}),
e2 as (select *, {clamped(total)} as final, list_filter(conflicts, lambda x: x <> 'contract_scope_mismatch') as differing from e1),
e3 as (select *, case when {has('hsn_sac_mismatch')} or {has('safety_code_mismatch')} then 'DATA' when len(differing) > 0 then 'DIFF'
  {"when sites_differ and final >= 60 then 'CROSS'" if cross_site else ''} when sites_differ then 'SCOPE' when {generic} and final >= 75 then 'GENERIC_HIGH' when {generic} then 'GENERIC'
  when final >= 85 then 'HIGH' when final >= 60 then 'MIDDLE' else 'LOW' end as outcome from e2),
e4 as (select *, {choose(1)} as business_status, {choose(2)} as rule_decision, {choose(3, str)} as rejection_reason, {level('final')} as confidence_level,
  list_sort(list_distinct(list_concat(same_features, {tagged('mf')}))) as evidence from e3),
e5 as (select e4.*, case when {shared('product_class')} <> '' then {shared('product_class')} else 'items' end as family, {shared('application_context')} as placed,
  {versus('rating')} as t_rating, {versus('color')} as t_color, {versus('function_or_media')} as t_media, {versus('type_code')} as t_type,
  {clean('a.HSN_SAC_CODE')} || ' vs ' || {clean('b.HSN_SAC_CODE')} as t_hsn, {clean('a.HAZARD_CODE')} || ' vs ' || {clean('b.HAZARD_CODE')} as t_safety,
  coalesce(nullif(a.ndesc, ''), nullif(b.ndesc, ''), nullif(a.npart, ''), nullif(b.npart, '')) as phrase, coalesce(a.CONTRACT, '') as site_a, coalesce(b.CONTRACT, '') as site_b from {both('e4')}),
e6 as (select *, case
  when business_status = '{vocab.DUPLICATE}' then concat_ws(' ', 'Descriptions and part numbers match after business synonym normalization.', 'Normalized evidence includes ''' || phrase || '''.', 'No critical conflicts were found.')
  when business_status = '{vocab.RELATED}' then case when {has('rating_mismatch')} then 'Both are ' || family || ' items, but rating differs: ' || t_rating || '.'
   when {has('color_mismatch')} then 'Both are ' || family || ' items, but color differs: ' || t_color || '.'
   when {has('function_or_media_mismatch')} then 'Both are ' || trim(placed || ' ' || family) || ', but function/media differs: ' || t_media || '.'
   when {has('type_code_mismatch')} then 'Both are ' || family || ' items, but type code differs: ' || t_type || '.'
   else 'Critical differentiators differ, so the records are related but not duplicate candidates.' end
  when business_status in ('{vocab.INSUFFICIENT}', '{vocab.POSSIBLE}') and {generic} then 'One description is generic or sparse. The system cannot confirm duplicate identity with high confidence from the available evidence.'
  when business_status = '{vocab.CONFLICT}' then concat_ws(' ', case when {has('hsn_sac_mismatch')} then 'HSN/SAC values differ: ' || t_hsn || '.' when {has('safety_code_mismatch')} then 'Safety code values differ: ' || t_safety || '.' end,
   'This is a data conflict, not a confirmed duplicate.')
  when business_status = '{vocab.CROSS_SITE}' then 'Records are from different CONTRACT/site values: ' || site_a || ' vs ' || site_b || '. Treat this as a possible standardization candidate, not a same-site duplicate.'
  when business_status = '{vocab.UNIQUE}' then 'Similarity is too low or scope rules prevent normal duplicate review.'
  else 'Manual review is recommended based on similarity and available business evidence.' end as body from e5),
decided as (select idx_a, idx_b, final as similarity_score, confidence_level, description_similarity, tfidf_score, fuzzy_score, part_no_similarity, technical as technical_token_score, business_status, rule_decision, rejection_reason,
  {action} when confidence_level in ('HIGH', 'MEDIUM') then 'Manual review recommended' else 'Not likely duplicate' end as recommended_action,
  concat_ws(' ', 'Status: ' || business_status || '.', body, case when len(evidence) > 0 then 'Matching evidence includes ' || array_to_string(list_transform(evidence[1:5], lambda x: replace(replace(x, '_', ' '), 'field:', 'field ')), ', ') || '.' else 'Matching evidence is limited.' end,
   case when len(messages) > 0 then 'Warnings: ' || array_to_string(messages, ' ') end) as explanation,
  {joined('mf')} as matched_fields, {joined('mm')} as mismatched_fields, {joined('evidence')} as matched_evidence, {joined(f"list_concat(list_concat(all_kinds, unequal), {tagged('mm')})")} as difference_kinds, {joined('messages')} as warnings,
  {warned('messages')} from e6)"""
