"""Queries of the value and similarity functions over sheet rows, plan lines and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.functions import similarity as S

from .registry import Registry

#: Cost in bits of reading one text for another, by the rows of the edit table: each row is folded from the one before.
_LOOK_ALIKE = " " + " ".join(f"{a}{b} {b}{a}" for a, b in S.GLYPH_PAIRS) + " "
COST = lambda a, b: f"""list_reduce(list_concat([range(0, (length({b}) + 1) * 5, 5)], [[ascii(x)::BIGINT] for x in string_split(upper({a}), '')]), lambda above, ch:
  list_reduce(list_concat([[above[1] + 5]], [[i] for i in range(1, length({b}) + 1)]), lambda own, i: list_append(own, least(own[-1] + 5, above[i[1] + 1] + 5,
    above[i[1]] + CASE WHEN chr(ch[1]::INT) = upper({b})[i[1]] THEN 0 WHEN contains('{_LOOK_ALIKE}', ' ' || chr(ch[1]::INT) || upper({b})[i[1]] || ' ') THEN 2 ELSE 8 END))))[-1]"""  # noqa: E731

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
c = F.col
COMPACT = lambda s: f"regexp_replace(upper(strip_accents({s})), '[^A-Z0-9]', '', 'g')"
CODE = lambda s: COMPACT(f"regexp_replace({s}, '^\\d\\d_', '')")
ZERO_O = lambda s: f"CASE WHEN length({CODE(s)}) <= 12 THEN translate({CODE(s)}, 'O', '0') ELSE {CODE(s)} END"
WRITTEN = lambda s: f"CASE WHEN trim({s}) IN ('\"', '''''', '”', '“', '„', '〃', '=', ',', ',,', ', ,', '') OR lower(trim({s})) = 'idem' THEN NULL ELSE trim({s}) END"
RATIO = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
KEY = ("sheet_uid", "pos")


@query("p1_compact", f"SELECT plan_key, {COMPACT("concat(cliente, ' São-Ção éí/', modelo)")} AS v FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", N.compact(F.concat("cliente", F.lit(" São-Ção éí/"), "modelo")).alias("v"))


@query("p2_normalize_code", f"SELECT plan_key, {CODE("concat(substr(snapshot_id, 4, 2), '_', modelo)")} AS v FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", N.normalize_code(F.concat(F.substring("snapshot_id", 4, 2), F.lit("_"), "modelo")).alias("v"))


@query("p3_zero_o_key", f"SELECT sheet_uid, pos, {ZERO_O('of_written')} AS v, {ZERO_O("'OOOOOOOO' || of_written")} AS long_v FROM sheet_rows")
def _(t):
    return t.rows.select(*KEY, N.zero_o_key(c("of_written")).alias("v"), N.zero_o_key(F.concat(F.lit("OOOOOOOO"), "of_written")).alias("long_v"))


@query("p4_code_variants", f"WITH k AS (SELECT sheet_uid, pos, {ZERO_O('of_written')} AS k FROM sheet_rows WHERE of_written IS NOT NULL) SELECT DISTINCT sheet_uid, pos, unnest([k, CASE WHEN starts_with(k, '0F') THEN k ELSE '0F' || k END]) AS v FROM k")
def _(t):
    return t.rows.where("of_written is not null").select(*KEY, F.explode(N.code_keys(c("of_written"), "OF")).alias("v"))


@query("p5_canonical_code", f"SELECT plan_key, regexp_replace({COMPACT('of_code')}, '^OF(.)', '\\1') AS v FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", N.canonical_code(c("of_code"), "OF").alias("v"))


@query("p6_strip_ref_prefix", "SELECT plan_key, regexp_replace(trim(of_code), '^(OF|OV)\\s*(\\d+)$', '\\2', 'i') AS v, regexp_replace(trim(concat(' ov ', ov)), '^(OF|OV)\\s*(\\d+)$', '\\2', 'i') AS w FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", N.strip_ref_prefix(c("of_code")).alias("v"), N.strip_ref_prefix(F.concat(F.lit(" ov "), "ov")).alias("w"))


@query("p7_order_codes", "SELECT sheet_uid, pos, CASE WHEN starts_with(of_written, 'OF') THEN of_written ELSE concat('OF', of_written, ',', of_written) END AS v FROM sheet_rows WHERE of_written IS NOT NULL")
def _(t):
    own = c("of_written")
    return t.rows.where(own.isNotNull()).select(*KEY, F.array_join(F.array_distinct(F.array(F.when(own.startswith("OF"), own).otherwise(F.concat(F.lit("OF"), own)), own)), ",").alias("v"))


_NUMBERS = "concat(CASE n % 4 WHEN 0 THEN '1.234,5' WHEN 1 THEN '0.125' WHEN 2 THEN '1,234.' ELSE '12+' END, CAST(n % 1000 AS STRING))"


@query("p8_parse_number", f"""WITH v AS (SELECT sheet_uid, qtd_written AS a, pos, {_NUMBERS.replace('n %', 'CAST(substr(sheet_uid, 3) AS BIGINT) %')} AS b FROM sheet_rows),
x AS (SELECT sheet_uid, pos, unnest(['a', 'b']) AS k, regexp_replace(trim(unnest([a, b])), '[^0-9.,\\-]', '', 'g') AS s FROM v),
p AS (SELECT *, CASE WHEN contains(s, '.') AND contains(s, ',') THEN CASE WHEN length(s) - strpos(reverse(s), ',') > length(s) - strpos(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
  WHEN regexp_full_match(s, '-?[1-9]\\d{{0,2}}(\\.\\d{{3}})+') THEN replace(s, '.', '') ELSE replace(s, ',', '.') END AS p FROM x)
SELECT sheet_uid, pos, k, TRY_CAST(CASE WHEN regexp_full_match(p, '-?(\\d+\\.?\\d*|\\.\\d+)') THEN p END AS DOUBLE) AS v FROM p""")
def _(t):
    r = t.rows.withColumn("n", F.substr("sheet_uid", F.lit(3)).cast("long"))
    r = r.select(*KEY, F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("qtd_written", F.expr(_NUMBERS)))).alias("k", "s"))
    return r.select(*KEY, "k", N.parse_number(c("s")).alias("v"))


@query("p9_parse_decimal", """WITH x AS (SELECT sheet_uid, pos, trim(CASE WHEN pos % 5 = 0 THEN '1 234,5' WHEN pos % 5 = 1 THEN '1+1' WHEN pos % 5 = 2 THEN '1.234,56' ELSE qtd_written END) AS s0 FROM sheet_rows),
y AS (SELECT *, CASE WHEN contains(s0, ' ') AND NOT regexp_full_match(s0, '[+-]?[1-9]\\d{0,2}( \\d{3})+([.,]\\d+)?') THEN NULL ELSE replace(s0, ' ', '') END AS s FROM x)
SELECT sheet_uid, pos, CAST(CASE WHEN regexp_full_match(s, '[+-]?[1-9]\\d{0,2}(\\.\\d{3})+,\\d+') THEN replace(replace(s, '.', ''), ',', '.') WHEN regexp_full_match(s, '[+-]?[1-9]\\d{0,2}(,\\d{3})+\\.\\d+') THEN replace(s, ',', '')
  WHEN regexp_full_match(s, '[+-]?[1-9]\\d{0,2}(\\.\\d{3})+') THEN replace(s, '.', '') WHEN regexp_full_match(s, '[+-]?(\\d+([.,]\\d+)?|[.,]\\d+)') THEN replace(s, ',', '.') END AS DOUBLE) AS v FROM y""")
def _(t):
    s = F.when(c("pos") % 5 == 0, "1 234,5").when(c("pos") % 5 == 1, "1+1").when(c("pos") % 5 == 2, "1.234,56").otherwise(c("qtd_written"))
    return t.rows.select(*KEY, N.parse_decimal(s).cast("double").alias("v"))


@query("p10_decimal_text", "SELECT plan_key, CASE WHEN qtd_planeada % 1 = 0 THEN CAST(CAST(qtd_planeada AS BIGINT) AS VARCHAR) END AS v, CASE WHEN comp_mm IS NULL THEN NULL ELSE regexp_replace(CAST(CAST(comp_mm AS BIGINT) AS VARCHAR) || '.25', '^$', '') END AS w FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", N.decimal_text(c("qtd_planeada").cast("decimal(18,4)")).alias("v"), N.decimal_text((c("comp_mm").cast("decimal(14,4)") + F.lit("0.25").cast("decimal(4,2)"))).alias("w"))


@query("p11_looks_numeric", "SELECT sheet_uid, pos, coalesce(regexp_full_match(qtd_written, '[0-9 .,\\-]+') AND regexp_matches(qtd_written, '\\d'), false) AS v, coalesce(regexp_full_match(modelo_written, '[0-9 .,\\-]+'), false) AS w FROM sheet_rows")
def _(t):
    return t.rows.select(*KEY, N.looks_numeric(c("qtd_written")).alias("v"), N.looks_numeric(c("modelo_written")).alias("w"))


_DIMS = """WITH d AS (SELECT sheet_uid, pos, regexp_replace(replace(upper(regexp_replace(coalesce(perfil_written, ''), '\\s+', '', 'g')), '×', 'X'), '^(CANTONEIRA|L)(\\d)', '\\2') AS rest FROM sheet_rows),
e AS (SELECT *, CASE WHEN regexp_full_match(rest, '\\d+(\\.\\d+)?(X\\d+(\\.\\d+)?)*') THEN string_split(rest, 'X') END AS dims FROM d)"""


@query("p12_parse_profile", _DIMS + " SELECT sheet_uid, pos, CASE WHEN dims IS NULL THEN '' ELSE 'L' END AS family, CASE WHEN len(dims) = 2 THEN 3 ELSE coalesce(len(dims), 0) END AS n_dims, CAST(dims[1] AS DOUBLE) AS d1, CAST(dims[-1] AS DOUBLE) AS d_last FROM e")
def _(t):
    p = t.rows.select(*KEY, N.parse_profile(c("perfil_written")).alias("p"))
    return p.select(*KEY, "p.family", F.coalesce(F.size("p.dims"), F.lit(0)).cast("long").alias("n_dims"), F.get("p.dims", F.lit(0)).cast("double").alias("d1"), F.element_at("p.dims", -1).cast("double").alias("d_last"))


@query("p13_profile_key", _DIMS + " SELECT sheet_uid, pos, CASE WHEN dims IS NULL THEN rest WHEN len(dims) = 2 THEN concat('L', dims[1], 'X', dims[1], 'X', dims[2]) ELSE 'L' || array_to_string(dims, 'X') END AS v FROM e")
def _(t):
    return t.rows.select(*KEY, N.profile_key(c("perfil_written")).alias("v"))


@query("p14_normalize_profile", _DIMS + ", k AS (SELECT DISTINCT perfil FROM plan_lines), f AS (SELECT *, CASE WHEN len(dims) = 2 THEN concat('L', dims[1], 'X', dims[1], 'X', dims[2]) ELSE 'L' || array_to_string(dims, 'X') END AS full_key FROM e) SELECT sheet_uid, pos, CASE WHEN rest = '' THEN NULL ELSE coalesce(k.perfil, f.rest) END AS v FROM f LEFT JOIN k ON full_key = k.perfil")
def _(t):
    known = t.plan.select(c("perfil").alias("known")).distinct()
    rows = t.rows.select(*KEY, N.parse_profile(c("perfil_written")).alias("p"))
    literal = F.regexp_replace(c("p.literal"), r"^(CANTONEIRA|L)(\d)", "$2")
    return rows.join(known, c("p.key") == c("known"), "left").select(*KEY, F.when(literal != "", F.coalesce("known", literal)).alias("v"))


@query("p15_profile_readings", _DIMS + ", r AS (SELECT sheet_uid, pos, CASE WHEN len(dims) = 2 THEN list_concat([dims[1]], dims) ELSE dims END AS d FROM e WHERE dims IS NOT NULL) SELECT sheet_uid, pos, array_to_string(d, 'X') AS reading, CAST(NULL AS DOUBLE) AS cut FROM r UNION ALL SELECT sheet_uid, pos, array_to_string(d[1:len(d) - 1], 'X'), CAST(d[-1] AS DOUBLE) FROM r WHERE len(d) >= 2")
def _(t):
    p = t.rows.select(*KEY, N.parse_profile(c("perfil_written")).alias("p")).where("p.dims is not null")
    r = p.select(*KEY, F.explode(N.profile_readings(c("p"))).alias("r"))
    return r.select(*KEY, F.array_join(F.transform("r.dims", N.decimal_text), "X").alias("reading"), c("r.cut").cast("double").alias("cut"))


_MATERIAL_NAMES = ["Aço Inox", "inoxidável", "Aço carbono", "Cantoneira", "IPE", "Chapa", "madeira", "Tubo Quadrado"]


@query("p16_material", f"""WITH v AS (SELECT p_partkey, list_extract({_MATERIAL_NAMES}, p_partkey % 8 + 1) AS v FROM part), k AS (SELECT *, {COMPACT('v')} AS k FROM v)
SELECT p_partkey, CASE WHEN k IN ('INOX', 'INOXIDAVEL', 'ACOINOX', 'ACOINOXIDAVEL') THEN 'INOX' WHEN k = 'ACOCARBONO' THEN 'CARBON_STEEL' ELSE '' END AS material,
  CASE k WHEN 'CANTONEIRA' THEN 'L' WHEN 'IPE' THEN 'IPE' WHEN 'CHAPA' THEN 'CHAPA' WHEN 'TUBOQUADRADO' THEN 'SQUARE' ELSE '' END AS family FROM k""")
def _(t):
    name = F.get(F.array(*map(F.lit, _MATERIAL_NAMES)), (c("p_partkey") % 8).cast("int"))
    return t.base("part").select("p_partkey", N.material_key(name).alias("material"), N.family_for_material(name).alias("family"))


@query("p17_field_value", "SELECT sheet_uid, pos, coalesce(nullif(trim(modelo_written), ''), nullif(trim(old), '')) AS modelo, coalesce(lower(trim(perf_comp)) IN ('x', '✓', 'v', 'sim', 'ok'), false) OR coalesce(lower(trim(qtd_written)) IN ('x', '✓', 'v', 'sim', 'ok'), false) AS whole FROM (SELECT *, perfil_written AS old FROM sheet_rows)")
def _(t):
    """A table with the field's new name and an old one (here the profile stands for it); a tick in either cell counts."""
    rows = t.rows.withColumnsRenamed({"modelo_written": "modelo"}).withColumn("referencia", c("perfil_written"))
    return rows.select(*KEY, N.field_value(rows.columns, "modelo", "referencia", "component_ref").alias("modelo"), (N.is_marked(c("perf_comp")) | N.is_marked(c("qtd_written"))).alias("whole"))


_CELLS = ["#VALUE!", " #ref! ", "#N/A", "#DIV/0!", "#NAME?", "#NUM!", "#NULL!", "#SPILL!", "#CALC!", "#FIELD!", "#BLOCKED!", "#UNKNOWN!", "#Getting_Data", "#N/D", "x", " X ", "OV1", "#"]


@query("p18_clean_plan_value", f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 20 < 18 THEN list_extract({_CELLS}, p_partkey % 20 + 1) ELSE p_name END AS v FROM part), e AS (SELECT *, regexp_full_match(upper(trim(v)), '#(VALUE!|REF!|N/A|DIV/0!|NAME\\?|NUM!|NULL!|SPILL!|CALC!|FIELD!|BLOCKED!|UNKNOWN!|GETTING_DATA)') AS bad FROM v)
SELECT p_partkey, CASE WHEN NOT bad THEN v END AS modelo, CASE WHEN NOT bad AND lower(trim(v)) <> 'x' THEN v END AS ov FROM e""")
def _(t):
    v = F.when(c("p_partkey") % 20 < 18, F.get(F.array(*map(F.lit, _CELLS)), (c("p_partkey") % 20).cast("int"))).otherwise(c("p_name"))
    return t.base("part").select("p_partkey", N.clean_plan_value(v).alias("modelo"), N.clean_plan_value(v, True).alias("ov"))


@query("p19_is_ditto", f"SELECT sheet_uid, pos, coalesce(of_written, '') <> '' AND ({WRITTEN('of_written')}) IS NULL AS v FROM sheet_rows")
def _(t):
    return t.rows.select(*KEY, N.is_ditto(c("of_written")).alias("v"))


_FIRMS = ["Acme Unipessoal SAS INC", "Sílva, Lda", "Sociedade de Obras do Norte SPA", "Müller GmbH e Filhos", "Co AG BV SRL", "Casa da Ponte Ltda."]


@query("p20_client_tokens", f"""WITH v AS (SELECT c_custkey, concat(list_extract({_FIRMS}, c_custkey % 6 + 1), ' ', c_name) AS v FROM customer), w AS (SELECT c_custkey, [{COMPACT('x')} for x in string_split_regex(trim(v), '\\s+')] AS w FROM v)
SELECT c_custkey, array_to_string([x for x in w if x <> '' AND NOT list_contains(string_split('SA LDA SL SAS GMBH AG BV SRL SPA LTD LTDA INC CO SOCIEDADE UNIPESSOAL E DE DO DA', ' '), x)], '|') AS v FROM w""")
def _(t):
    firm = F.get(F.array(*map(F.lit, _FIRMS)), (c("c_custkey") % 6).cast("int"))
    return t.base("customer").select("c_custkey", F.array_join(N.client_tokens(F.concat(firm, F.lit(" "), "c_name")), "|").alias("v"))


_DATE = """(SELECT sheet_uid, n, TRY_CAST(CASE WHEN regexp_full_match(data, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN data WHEN regexp_full_match(data, '\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{2,4}') THEN
  concat(CASE WHEN length(regexp_extract(data, '(\\d+)$', 1)) = 2 THEN '20' ELSE '' END, regexp_extract(data, '(\\d+)$', 1), '-', lpad(regexp_extract(data, '^\\d+[/.\\-](\\d+)', 1), 2, '0'), '-', lpad(regexp_extract(data, '^(\\d+)', 1), 2, '0')) END AS DATE) AS d FROM headers)"""


@query("p21_canonical_date", f"SELECT sheet_uid, d FROM {_DATE}")
def _(t):
    return t.headers.select("sheet_uid", N.canonical_date(c("data")).alias("d"))


@query("p22_previous_business_day", f"SELECT sheet_uid, CAST(d - CAST(CASE dayofweek(d) WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS DATE) AS d FROM {_DATE}")
def _(t):
    return t.headers.select("sheet_uid", N.previous_business_day(N.canonical_date(c("data"))).alias("d"))


@query("p23_assumed_sheet_date", "WITH b AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST('1999-03-08' AS DATE) ELSE CAST(ts AS DATE) END AS d FROM events) SELECT event_id, CAST(d - CAST(CASE dayofweek(d) WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS DATE) AS d FROM b")
def _(t):
    name = F.when(c("event_id") % 3 == 0, "1999-03-08_sheet.pdf").otherwise("photo.jpg")
    base = F.coalesce(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date"), c("ts").cast("date"))
    return t.base("events").select("event_id", N.previous_business_day(base).alias("d"))


@query("p24_source_from_path", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN concat('plan ', event_type, '.pdf') END AS file, CASE WHEN event_id % 4 > 0 THEN event_id % 30 END AS page FROM events")
def _(t):
    path = F.concat(F.lit("/data/img/"), F.when(c("event_id") % 4 > 0, "0123456789abcdef_").otherwise("photo_"), F.lit("plan "), "event_type", F.lit("_p"), F.lpad((c("event_id") % 30).cast("string"), 2, "0"), F.lit(".png"))
    name, shape = F.substring_index(path, "/", -1), r"^[0-9a-f]{16}_(.+)_p(\d{1,4})\.[A-Za-z0-9]{1,5}$"
    return t.base("events").select("event_id", F.when(name.rlike(shape), F.concat(F.regexp_extract(name, shape, 1), F.lit(".pdf"))).alias("file"), F.when(name.rlike(shape), F.regexp_extract(name, shape, 2).cast("long")).alias("page"))


_NOTES = ["arrumação e limpezas", "Sem  trabalho", "limpezada", "AGUARDAR MATERIAL", "peça"]


@query("p25_classify_row", f"""WITH n AS (SELECT *, CASE WHEN pos % 2 = 0 THEN list_extract({_NOTES}, CAST(pos % 5 + 1 AS BIGINT)) END AS note FROM sheet_rows),
s AS (SELECT *, upper(strip_accents(concat_ws(' ', {WRITTEN('of_written')}, {WRITTEN('perfil_written')}, {WRITTEN('note')}, {WRITTEN('qtd_written')}))) AS said FROM n)
SELECT sheet_uid, pos, CASE WHEN pos % 11 = 0 THEN 'deleted' WHEN pos % 13 = 0 THEN 'activity' WHEN said = '' THEN 'empty' WHEN qtd_written IS NOT NULL AND replace(qtd_written, '.', '')::DOUBLE > 0 THEN 'production'
  WHEN regexp_matches(said, '\\b(LIMPEZAS?|ARRUMACAO|SEM\\s+TRABALHO|AGUARDAR\\s+MATERIAL)\\b') THEN 'activity' ELSE 'production' END AS kind FROM s""")
def _(t):
    note = F.when(c("pos") % 2 == 0, F.get(F.array(*map(F.lit, _NOTES)), (c("pos") % 5).cast("int")))
    return t.rows.select(*KEY, N.classify_row(c("qtd_written"), c("pos") % 11 == 0, c("of_written"), c("perfil_written"), note, activity=c("pos") % 13 == 0).alias("kind"))


_PLACES = ["Pavilhão 3 eq 2", "PAV12", "Pavimento 4", "interno", "Pav 3 eq", "Interno SA"]


@query("p26_is_internal", f"""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 7 < 6 THEN list_extract({_PLACES}, c_custkey % 7 + 1) ELSE c_name END AS v, CASE WHEN c_custkey % 5 = 0 THEN ' Interno ' ELSE c_mktsegment END AS o FROM customer)
SELECT c_custkey, {COMPACT('v')} = 'INTERNO' OR {COMPACT('o')} = 'INTERNO' OR regexp_full_match({COMPACT('v')}, 'PAV(ILHAO)?[0-9]+(EQ[0-9]+)?') AS v FROM v""")
def _(t):
    place = F.when(c("c_custkey") % 7 < 6, F.get(F.array(*map(F.lit, _PLACES)), (c("c_custkey") % 7).cast("int"))).otherwise(c("c_name"))
    return t.base("customer").select("c_custkey", N.is_internal(place, F.when(c("c_custkey") % 5 == 0, " Interno ").otherwise(c("c_mktsegment"))).alias("v"))


@query("p27_row_has_content", f"SELECT sheet_uid, pos, ({WRITTEN('perf_comp')}) IS NOT NULL OR ({WRITTEN('modelo_written')}) IS NOT NULL AS v FROM sheet_rows")
def _(t):
    return t.rows.select(*KEY, F.exists(F.array("perf_comp", "modelo_written"), lambda x: N.written(x).isNotNull()).alias("v"))


@query("p28_business_identity", "SELECT plan_key, CASE WHEN comp_mm > 0 THEN concat_ws('|', of_code, modelo, perfil, CAST(CAST(comp_mm AS BIGINT) AS VARCHAR)) END AS v FROM plan_lines")
def _(t):
    parts = [c("of_code"), c("modelo"), N.profile_key(c("perfil")), c("comp_mm").cast("long").cast("string")]
    return t.plan.select("plan_key", F.when(c("comp_mm") > 0, F.concat_ws("|", *parts)).alias("v"))


@query("p29_plan_identity", "SELECT plan_key, of_code, ov, cliente, modelo, perfil, comp_mm FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", F.struct("of_code", "ov", "cliente", "modelo", "perfil", "comp_mm").alias("i")).select("plan_key", "i.*")


@query("p30_fingerprint", """SELECT plan_key, sha256(concat('{"cliente":"', cliente, '","modelo":"', modelo, '","of_code":"', of_code, '","perfil":"', perfil, '"}')) AS fingerprint FROM plan_lines""")
def _(t):
    return t.plan.select("plan_key", N.fingerprint("perfil", "of_code", "modelo", "cliente").alias("fingerprint"))


@query("p31_display_order", "SELECT sheet_uid, pos, CASE WHEN pos % 3 = 0 THEN 100 - pos WHEN pos % 3 = 1 THEN pos * 2 ELSE pos + 1 END AS v FROM sheet_rows")
def _(t):
    shown, paper = F.when(c("pos") % 3 == 0, 100 - c("pos")), F.when(c("pos") % 3 == 1, c("pos") * 2)
    return t.rows.select(*KEY, F.coalesce(shown, paper, c("pos") + 1).cast("long").alias("v"))


def pairs(t):
    return t.rows.join(t.plan, t.rows["true_plan_key"] == t.plan["plan_key"])


_PAIRS = "sheet_rows r JOIN plan_lines p ON r.true_plan_key = p.plan_key"


@query("e1_ratio", f"SELECT sheet_uid, pos, {RATIO('modelo_written', 'modelo')} AS v FROM {_PAIRS} WHERE modelo_written IS NOT NULL")
def _(t):
    return pairs(t).where("modelo_written is not null").select(*KEY, S.ratio(c("modelo_written"), c("modelo")).alias("v"))


@query("e2_code_similarity", f"SELECT sheet_uid, pos, CASE WHEN coalesce({CODE('of_written')}, '') = '' THEN 0.0 WHEN ({ZERO_O('of_written')}) = ({ZERO_O('of_code')}) THEN 1.0 ELSE {RATIO(CODE('of_written'), CODE('of_code'))} END AS v FROM {_PAIRS}")
def _(t):
    return pairs(t).select(*KEY, S.code_similarity(c("of_written"), c("of_code")).alias("v"))


@query("e3_text_similarity", "SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 ELSE 0.6 + 0.2 END AS DOUBLE) AS v FROM customer")
def _(t):
    name = F.when(c("c_custkey") % 3 == 0, F.lower("c_name")).when(c("c_custkey") % 3 == 1, F.substring("c_name", 1, 11)).otherwise(F.concat(F.lit("Other "), "c_name"))
    truth = F.when(c("c_custkey") % 3 == 2, F.concat("c_name", F.lit(" Norte"))).otherwise(c("c_name"))
    return t.base("customer").select("c_custkey", S.text_similarity(name, truth).alias("v"))


@query("e4_numeric_similarity", "SELECT plan_key, CASE WHEN comp_mm IS NULL THEN 0.0 WHEN (qtd_planeada % 9) <= 2 THEN 1.0 ELSE greatest(0.0, 1 - ((qtd_planeada % 9) - 2) / 6.0::DOUBLE) END AS v FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", S.numeric_similarity(c("comp_mm"), c("comp_mm") + c("qtd_planeada") % 9, 2.0).alias("v"))


def distinct_pairs(t):
    """Written and true models of rows, each pair once: evidence is computed on these and joined back."""
    return pairs(t).where("modelo_written is not null").select(F.upper("modelo_written").alias("w"), F.upper("modelo").alias("truth")).distinct()


_NEAR_PAIRS = f"""p AS (SELECT DISTINCT upper(modelo_written) AS w, upper(modelo) AS truth FROM {_PAIRS} WHERE modelo_written IS NOT NULL)"""


@query("e5_align_cost", f"WITH {_NEAR_PAIRS} SELECT w, truth, CAST({COST('w', 'truth')} AS BIGINT) AS cost FROM p")
def _(t):
    return distinct_pairs(t).select("w", "truth", S.align_cost(c("w"), c("truth")).cast("long").alias("cost"))


@query("e6_channel_evidence", f"WITH {_NEAR_PAIRS} SELECT w, truth, round(greatest(0.0, least(0.85, 1 - {COST('w', 'truth')} / 12.0::DOUBLE)), 9) AS g FROM p")
def _(t):
    return distinct_pairs(t).select("w", "truth", F.round(S.look_alike_evidence(c("w"), c("truth")), 9).alias("g"))


@query("e7_value_weight", "WITH f AS (SELECT modelo, count(*) AS n FROM plan_lines GROUP BY modelo), a AS (SELECT count(*) AS n FROM plan_lines) SELECT modelo, CAST(round(greatest(1.0, least(14.0, log2(0.6::DOUBLE / (f.n / greatest(a.n, 1000)::DOUBLE)))) * 1000000) AS BIGINT) AS v FROM f, a")
def _(t):
    freq = t.plan.groupBy("modelo").agg(F.count(F.lit(1)).alias("n"))
    return freq.crossJoin(t.plan.agg(F.count(F.lit(1)).alias("total"))).select("modelo", S.micro_bits(S.value_weight(c("n"), c("total"))).alias("v"))  # one row on the right


@query("e8_identity_bits", f"""WITH k AS (SELECT DISTINCT translate(modelo, 'O', '0') AS k FROM plan_lines), x AS (SELECT sheet_uid, pos, {RATIO('modelo_written', 'modelo')} AS s, modelo_written IS NULL AS blank, k.k IS NOT NULL AS known FROM {_PAIRS} LEFT JOIN k ON translate(modelo_written, 'O', '0') = k.k)
SELECT sheet_uid, pos, CAST(CASE WHEN blank THEN 0.0 WHEN s >= 1 THEN 10.0 WHEN s >= 0.9 THEN 5.0 WHEN known THEN -3.0 ELSE -1.5 END AS DOUBLE) AS v FROM x""")
def _(t):
    known = t.plan.select(F.translate("modelo", "O", "0").alias("k")).distinct().withColumn("known", F.lit(True))
    p = pairs(t).join(known, F.translate("modelo_written", "O", "0") == c("k"), "left")
    return p.select(*KEY, S.identity_bits(S.ratio(c("modelo_written"), c("modelo")), F.lit(0.0), F.lit(10.0), F.coalesce("known", F.lit(False)), c("modelo_written").isNull()).alias("v"))


@query("e10_context_bonus", "WITH last AS (SELECT max(sheet_date) AS d FROM facts), act AS (SELECT DISTINCT of_code FROM facts, last WHERE sheet_date >= d - CAST(400 AS INTEGER)) SELECT plan_key, CAST(CASE WHEN a.of_code IS NULL THEN 0.0 ELSE 2.0 END AS DOUBLE) AS v FROM plan_lines p LEFT JOIN act a ON p.of_code = a.of_code")
def _(t):
    last = t.facts.agg(F.max("sheet_date").alias("d"))
    active = t.facts.crossJoin(F.broadcast(last)).where(c("sheet_date") >= F.date_sub("d", 400)).select("of_code").distinct().withColumn("bonus", F.lit(2.0))  # one date
    return t.plan.join(active, "of_code", "left").select("plan_key", F.coalesce("bonus", F.lit(0.0)).alias("v"))


_SIDES = """d AS (SELECT p_partkey, 40 + 5 * (p_size % 8) AS a, 3 + p_size % 6 AS t, CAST(p_partkey % 97 AS DOUBLE) / 100 AS gap, p_partkey % 7 AS kind FROM part)"""


@query("e9_dims_evidence", """WITH n AS (SELECT count(*) AS total FROM part), s AS (SELECT p_size, count(*) AS joint FROM part GROUP BY p_size), k AS (SELECT p_partkey, p_partkey % 3 AS agree, p_partkey % 4 AS disagree, joint, total FROM part JOIN s USING (p_size), n)
SELECT p_partkey, round(CASE WHEN agree > 0 THEN least(12.0, -log2(greatest(joint / total::DOUBLE, pow(0.1, agree), 1e-9))) ELSE 0 END + CASE WHEN disagree > 0 THEN greatest(-5.0, -2.5 * disagree) ELSE 0 END, 9) AS v FROM k""")
def _(t):
    part = t.base("part")
    joint = part.groupBy("p_size").agg(F.count(F.lit(1)).alias("joint"))
    k = part.join(joint, "p_size").crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("total"))))  # one row
    return k.select("p_partkey", F.round(S.dims_evidence(c("p_partkey") % 3, c("joint"), c("p_partkey") % 4, c("total")), 9).alias("v"))


@query("e11_profile_score", f"""WITH {_SIDES} SELECT p_partkey, round(CASE kind
  WHEN 0 THEN CASE WHEN gap <= 0.001 THEN 10.0 WHEN gap <= greatest(0.01, t * 0.01::DOUBLE) THEN 4.0 ELSE -10.0 END
  WHEN 1 THEN CASE WHEN gap <= 0.001 THEN 7.0 WHEN gap <= greatest(0.5, a * 0.01::DOUBLE) THEN 6.0 ELSE -10.0 END
  WHEN 2 THEN CASE WHEN gap <= 0.001 THEN 7.0 WHEN gap <= greatest(0.05, a * 0.01::DOUBLE) THEN 6.0 ELSE -10.0 END
  WHEN 3 THEN -14.0 WHEN 4 THEN 0.0 WHEN 5 THEN -3.0
  ELSE CASE WHEN a % 10 = 0 THEN 4.0 WHEN 1 - levenshtein('SEMPERFIL' || CAST(a AS VARCHAR), 'SEMPERFIL' || CAST(a * 10 + t AS VARCHAR)) / length('SEMPERFIL' || CAST(a * 10 + t AS VARCHAR))::DOUBLE >= 0.8 THEN 2.0 * (1 - levenshtein('SEMPERFIL' || CAST(a AS VARCHAR), 'SEMPERFIL' || CAST(a * 10 + t AS VARCHAR)) / length('SEMPERFIL' || CAST(a * 10 + t AS VARCHAR))::DOUBLE) ELSE -4.0 END END, 9) AS v FROM d""")
def _(t):
    """Each outcome of the ladder, with gaps on both sides of its bounds."""
    d = t.base("part").select("p_partkey", (40 + 5 * (c("p_size") % 8)).alias("a"), (3 + c("p_size") % 6).alias("t"), ((c("p_partkey") % 97).cast("decimal(6,2)") / 100).cast("decimal(6,2)").alias("gap"), (c("p_partkey") % 7).alias("kind"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    a, th, k = c("a"), c("t"), c("kind")
    written = (
        F.when(k == 0, text("L", a, "X", a, "X", th + c("gap"))).when(k == 1, text("RECT", a + c("gap"), "X", a)).when(k == 2, text("RECT", a, "X", a + c("gap")))
        .when(k == 3, text("HEA", a)).when(k == 4, F.lit(" ")).when(k == 5, text("L", a, "X", a, "X", th)).otherwise(text("sem perfil ", a))
    )
    truth = F.when(k.isin(0, 3, 4), text("L", a, "X", a, "X", th)).when(k.isin(1, 2), text("RECT", a, "X", a, "X", th)).when(k == 5, F.lit(None).cast("string")).when(a % 10 == 0, text("SEM PERFIL ", a)).otherwise(text("SEM PERFIL ", a * 10 + th))
    # "RECT" begins no name in the list: the long name does
    p = d.select("p_partkey", N.parse_profile(F.regexp_replace(written, "^RECT", "Tubo Rectangular ")).alias("w"), N.parse_profile(F.regexp_replace(truth, "^RECT", "TUBO RETANGULAR ")).alias("t"))
    return p.select("p_partkey", F.round(S.profile_score(c("w"), c("t")), 9).alias("v"))


@query("e12_length_score", "SELECT plan_key, round(CASE WHEN comp_mm IS NULL THEN -2.0 WHEN qtd_planeada % 37 <= 1 THEN 6.0 ELSE greatest(-8.0, 6.0 - 2.0 * (qtd_planeada % 37 - 1) / greatest(1.0, comp_mm / 200)) END, 9) AS v FROM plan_lines")
def _(t):
    return t.plan.select("plan_key", F.round(S.length_score(c("comp_mm") - c("qtd_planeada") % 37, c("comp_mm")), 9).alias("v"))


@query("e13_geometry_evidence", """WITH d AS (SELECT p_partkey, 3 + p_size % 6 AS t, p_partkey % 4 AS kind, 100 + p_partkey % 9 AS cut, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 100.0::DOUBLE END AS length, p_partkey % 3 AS material FROM part),
s AS (SELECT *, CASE WHEN length IS NULL THEN -2.0 WHEN cut - 100 <= 1 THEN 6.0 ELSE greatest(-8.0, 6.0 - (cut - 101) * 2.0) END AS bits FROM d),
m AS (SELECT *, CASE material WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 ELSE -4.0 END AS m FROM s)
SELECT p_partkey, round(CAST(CASE kind WHEN 0 THEN 10.0 + m WHEN 1 THEN greatest(-10.0, 10.0 + bits - 6.5) + m WHEN 2 THEN 10.0 - 2.0 + m ELSE 0.0 + m END AS DOUBLE), 9) AS v FROM m""")
def _(t):
    """The best of a profile's readings: as it stands, or with its last dimension as a length."""
    k = c("p_partkey") % 4
    side = (3 + c("p_size") % 6).cast("string")
    cut = (100 + c("p_partkey") % 9).cast("string")
    written = F.when(k == 0, F.concat(F.lit("IPE"), side)).when(k == 1, F.concat(F.lit("IPE"), side, F.lit("X"), cut)).when(k == 2, F.concat(F.lit("Q"), side, F.lit("x2"))).otherwise("")
    truth = F.when(k == 2, F.concat(F.lit("Ø"), side, F.lit("X2"))).otherwise(F.concat(F.lit("IPE"), side))
    d = t.base("part").select("p_partkey", N.parse_profile(written).alias("w"), N.parse_profile(truth).alias("t"), F.when(c("p_partkey") % 5 != 0, 100.0).alias("length"), (c("p_partkey") % 3).alias("material"))
    readings = d.select("*", F.explode(N.profile_readings(c("w"))).alias("r")).withColumn("w", c("w").withField("dims", c("r.dims")))
    own = F.when(c("material") == 0, "").otherwise("INOX")
    plan = F.when(c("material") == 1, "INOX").otherwise("CARBON_STEEL")
    return readings.groupBy("p_partkey").agg(F.round(F.max(S.geometry_evidence(c("w"), c("t"), own, plan, c("r.cut"), c("length"))), 9).alias("v"))


@query("e14_code_evidence", f"""WITH n AS (SELECT ov, count(DISTINCT of_code) AS orders FROM plan_lines GROUP BY ov), x AS (SELECT r.sheet_uid, r.pos, r.modelo_written AS w, p.modelo AS t, substr(p.ov, 3) AS ov, CASE WHEN r.pos % 4 = 0 THEN replace(substr(p.ov, 3), '0', 'O') ELSE substr(p.ov, 3) END AS ov_w, n.orders FROM {_PAIRS} JOIN n ON n.ov = p.ov),
g AS (SELECT *, greatest(0.0, least(0.85, 1 - {COST('w', 't')} / 12.0::DOUBLE)) AS gm, greatest(0.0, least(0.85, 1 - {COST('ov_w', 'ov')} / 12.0::DOUBLE)) AS go, 7.0 * greatest(0.7, 1.0 - 0.1 * log2(greatest(orders, 1))) AS wo FROM x)
SELECT sheet_uid, pos, round(CASE WHEN w IS NULL THEN 0.0 WHEN w = t THEN 10.0 WHEN {RATIO('w', 't')} >= 0.9 THEN greatest(0.45, gm) * 10 WHEN gm > 0 THEN gm * 10 ELSE -5.5 END, 9) AS modelo,
  round(CASE WHEN ov_w = ov THEN wo WHEN {RATIO('ov_w', 'ov')} >= 0.9 THEN greatest(0.45, go) * wo WHEN go > 0 THEN go * wo ELSE -0.55 * wo END, 9) AS ov FROM g""")
def _(t):
    orders = t.plan.groupBy("ov").agg(F.count_distinct("of_code").alias("orders"))
    p = pairs(t).join(orders, "ov").withColumn("o", F.substr("ov", F.lit(3)))
    p = p.withColumn("ow", F.when(c("pos") % 4 == 0, F.translate("o", "0", "O")).otherwise(c("o")))
    g = lambda a, b: F.coalesce(S.look_alike_evidence(c(a), c(b)), F.lit(0.0))
    return p.select(*KEY, F.round(S.code_evidence("modelo", c("modelo_written"), c("modelo"), g("modelo_written", "modelo"), F.lit(1)), 9).alias("modelo"), F.round(S.code_evidence("ov", c("ow"), c("o"), g("ow", "o"), c("orders")), 9).alias("ov"))


@query("e15_same_identity", f"SELECT sheet_uid, pos, coalesce(({ZERO_O('of_written')}) = regexp_replace({ZERO_O('of_code')}, '^0F', ''), false) AS v FROM {_PAIRS}")
def _(t):
    return pairs(t).select(*KEY, F.coalesce(N.zero_o_key(c("of_written")) == F.regexp_replace(N.zero_o_key(c("of_code")), "^0F", ""), F.lit(False)).alias("v"))
