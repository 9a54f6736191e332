"""Column profiling: which columns hold personal data, how surely, and why.

All columns are read in one pass: the table is unpivoted to (column, value)
cells, each cell is turned into a few flags, and one partial aggregation counts
them.  Only a handful of rows per column reaches the shuffle, whatever the
input size.  With a number or date as row key all aggregation buffers are
fixed-width, so the aggregation hashes and never sorts the cells; a text as row
key makes it sort.  Columns whose distinct values count are read a second time.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe import fixed_values as V
from veilframe.functions.numbers import looks_like_date, parse_number, round_exact
from veilframe.functions.spans import PATTERNS, find_spans, span_context, span_valid
from veilframe.functions.text import (
    column_hint, fold_arabic, folded_address_places, folded_is_city, let, name_shape, named, normalize_digits, sql_text, strip)
from veilframe.operators.corpus import base_risk_of, category_of, label_of, lower_risk
from veilframe.session import stage

# rows are dealt to lanes by a hash of their key; each lane reports its first
# row, which bounds where the first rows of a column lie
LANES = 8
SAMPLES = 3
SAMPLE_LENGTH = 60
_SHORT = {"SAUDI_NATIONAL_ID": "id", "SAUDI_MOBILE": "mobile", "SAUDI_IBAN": "iban", "EMAIL_ADDRESS": "email"}
_GROUPS = [*_SHORT.values(), "name", "address", "any"]
_HINT_GROUPS = list(V.COLUMN_KEYWORDS)
_OTHER_ORDER = ["NAME", "SAUDI_ADDRESS", "CUSTOMER_ID", "AGE", "SALARY", "DATE_OF_BIRTH", "CITY", "DISTRICT",
                "GENDER", "JOB_TITLE", "NATIONALITY"]


#: Found by the column's name alone, so that other columns need not be read for them.
_BY_HINT = {"CUSTOMER_ID", "AGE", "SALARY", "DATE_OF_BIRTH", "DISTRICT", "GENDER", "JOB_TITLE", "NATIONALITY"}


def add_pattern(entity: str, short: str) -> None:
    """Count the matches of one more pattern entity; ``short`` names its counters."""
    _SHORT[entity] = short
    _GROUPS.insert(len(_SHORT) - 1, short)
    _HINT_GROUPS.append(entity)


def drop_pattern(entity: str) -> None:
    _GROUPS.remove(_SHORT.pop(entity))
    _HINT_GROUPS.remove(entity)


def hints_for(columns: list[str]) -> dict[str, dict[str, str]]:
    """``{group: {column: keyword}}`` for the columns whose names say what they hold."""
    return {g: {c: k for c in columns if (k := column_hint(c, g))} for g in _HINT_GROUPS}


def profiled_columns(df: DataFrame, row_key: str | None) -> list[str]:
    return [c for c in df.columns if c != row_key]


#: Longest text key, in bytes, that is held as a number while cells are counted.
NUMBERED_BYTES = 15
_HALF = "18446744073709551616BD"            # 2 ** 64


def _number_of(key: Column) -> Column:
    """A text of up to NUMBERED_BYTES bytes as a whole number of the same order."""
    digits = F.rpad(F.hex(key.cast("binary")), 2 * NUMBERED_BYTES, "0")
    upper, lower = (F.conv(F.substring(digits, a, n), 16, 10).cast("decimal(20,0)") for a, n in ((1, 14), (15, 16)))
    return (upper.cast("decimal(18,0)") * F.expr(_HALF) + lower).cast("decimal(38,0)")


def _text_of(number: Column) -> Column:
    """The text that a number stands for."""
    lower = (number % F.expr(_HALF)).cast("decimal(20,0)")
    upper = ((number - lower) / F.expr(_HALF)).cast("decimal(20,0)")
    digits = F.concat(*[F.lpad(F.conv(half.cast("string"), 10, 16), n, "0") for half, n in ((upper, 14), (lower, 16))])
    return F.rtrim(F.unhex(digits).cast("string"), F.lit("\x00"))


def _fits_a_number(df: DataFrame, row_key: str) -> bool:
    """Whether all text keys are short enough and none holds the byte that fills up short ones; one pass over the keys alone."""
    key = named(row_key)
    found = df.agg(F.max(F.octet_length(key)).alias("longest"), F.count_if(F.contains(key, F.lit("\x00"))).alias("filled")).first()
    return (found["longest"] or 0) <= NUMBERED_BYTES and not found["filled"]


def cells(df: DataFrame, row_key: str | None, columns: list[str]) -> DataFrame:
    """(row_key, column, value) for every cell that is neither null nor blank, stripped."""
    # without a row key the scan order stands in for it; it is taken before any shuffle
    key = named(row_key) if row_key else F.monotonically_increasing_id()
    wide = df.select(key.alias("__row_key"), *[named(c).cast("string").alias(c) for c in columns])
    long = wide.unpivot(["__row_key"], [named(c) for c in columns], "column", "raw")
    return long.select(F.col("__row_key").alias("row_key"), "column", strip(F.col("raw")).alias("value")).where("value <> ''")


def _in(columns) -> str:
    names = ", ".join(sql_text(c) for c in columns)
    return f"column in ({names})" if names else "false"


def _pattern_flags(plain: Column, entity: str) -> Column:
    """Struct of what one pattern says about a cell; null when it does not occur."""
    pattern = PATTERNS[entity]

    def flags(valid, full, place):
        return F.struct(valid.alias("valid"), full.alias("full"), place.cast("int").alias("place"))

    def judge(spans):
        first = F.get(spans, F.lit(0))
        valid = F.exists(spans, lambda x: span_valid(x["frag"], entity)) if pattern.validator else F.lit(True)
        full = first["end"] - first["start"] >= F.length(plain) * V.FULL_MATCH_SHARE
        return F.when(F.size(spans) > 0, flags(valid, full, span_context(plain, first, entity)))

    # most cells of an identifier column are the identifier and nothing else
    return (F.when(plain.rlike(pattern.whole), flags(span_valid(plain, entity), F.lit(True), F.lit(None)))
            .when(pattern.candidate(plain), let(find_spans(plain, entity), judge)))


def _cell_flags(long: DataFrame, hints: dict, entities: set[str] | None = None) -> DataFrame:
    """Flags of each cell; those that none of ``entities`` asks for are not computed."""
    def only(wanted: str, flag: Column, kind: str) -> Column:
        return flag if entities is None or wanted in entities else F.lit(None).cast(kind)

    value, plain, folded = F.col("value"), F.col("plain"), F.col("folded")
    numeric = F.when(F.expr(_in({**hints["AGE"], **hints["SALARY"]})), parse_number(value))
    dated = F.when(F.expr(_in(hints["DATE_OF_BIRTH"])), looks_like_date(plain)).otherwise(False)
    address = only("SAUDI_ADDRESS", F.when(F.length(value) >= V.ADDRESS_MIN_LENGTH, folded_address_places(folded)), "array<int>")
    shape = only("NAME", name_shape(value, folded), "struct<shape_ok: boolean, lexicon_hit: boolean, is_arabic: boolean>")
    city = only("CITY", folded_is_city(folded), "boolean")
    # the arrays of spans stay inside one expression; only small flags leave the projection
    found = long.withColumns({"plain": normalize_digits(value), "folded": fold_arabic(value)}).select(
        "row_key", "column", "value", *[only(e, _pattern_flags(plain, e), "struct<valid: boolean, full: boolean, place: int>").alias(s) for e, s in _SHORT.items()],
        shape.alias("name"), address.alias("address_places"), numeric.alias("number"),
        dated.alias("is_date"), city.alias("is_city"))
    flags = [x for s in _SHORT.values() for x in (
        f"{s} is not null as {s}_hit", f"coalesce({s}.valid, false) as {s}_valid",
        f"coalesce({s}.full, false) as {s}_full", f"{s}.place as {s}_place")]
    return found.selectExpr(
        "row_key", "column", "value", *flags, "number", "is_date", "is_city", "true as any_hit",
        "name.shape_ok as name_hit", "name.lexicon_hit as name_lexicon", "name.is_arabic as name_arabic",
        "address_places is not null as address_hit",
        # the first two keywords of the cell, one bit each
        "aggregate(slice(address_places, 1, 2), 0, (bits, p) -> bits | shiftleft(1, cast(p as int) - 1)) as address_bits")


def _lane_totals(flags: DataFrame) -> DataFrame:
    measures = {
        "n": "count(*)", "name_n": "count_if(name_hit)", "lexicon_n": "count_if(name_lexicon)",
        "arabic_n": "count_if(name_arabic)", "address_n": "count_if(address_hit)",
        "address_bits": "bit_or(if(address_hit, address_bits, 0))", "number_n": "count(number)",
        "age_n": "count_if(number between 0 and 120)", "date_n": "count_if(is_date)", "city_n": "count_if(is_city)"}
    for s in _SHORT.values():
        measures |= {
            f"{s}_n": f"count_if({s}_hit)", f"{s}_valid_n": f"count_if({s}_valid)",
            f"{s}_full_n": f"count_if({s}_full)", f"{s}_context_n": f"count({s}_place)",
            f"{s}_place_key": f"min(if({s}_place is not null, row_key, null))",
            f"{s}_place": f"min_by({s}_place, if({s}_place is not null, row_key, null))"}
    measures |= {f"{g}_key": f"min(if({g}_hit, row_key, null))" for g in _GROUPS}
    measures |= {f"{g}_last": f"max(if({g}_hit, row_key, null))" for g in _GROUPS}
    return flags.groupBy("column", F.expr(f"pmod(xxhash64(row_key), {LANES}) as lane")).agg(
        *[F.expr(f"{m} as {name}") for name, m in measures.items()])


def _column_totals(lanes: DataFrame) -> DataFrame:
    measures = {c: f"sum({c})" for c in lanes.columns if c == "n" or c.endswith("_n")}
    measures["address_bits"] = "bit_or(address_bits)"
    measures |= {f"{s}_place": f"min_by({s}_place, {s}_place_key)" for s in _SHORT.values()}
    # at most LANES keys are collected; the third smallest bounds where the first three rows are, else the last hit does
    measures |= {f"{g}_bound": f"coalesce(get(array_sort(collect_list({g}_key)), {SAMPLES - 1}), max({g}_last))" for g in _GROUPS}
    return lanes.groupBy("column").agg(*[F.expr(f"{m} as {name}") for name, m in measures.items()])


def distinct_counts(long: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column.  Exact counting collapses repeats before the shuffle."""
    chosen = long.where(_in(columns))
    if approximate:
        return chosen.groupBy("column").agg(F.hll_sketch_estimate(F.hll_sketch_agg("value", F.lit(14))).alias("distinct_n"))
    return (chosen.groupBy("column", "value").agg(F.lit(1).alias("one"))
            .groupBy("column").agg(F.count("*").alias("distinct_n")))


def profile_columns(df: DataFrame, row_key: str | None = None, columns: list[str] | None = None,
                    approximate: bool = False, entities: set[str] | None = None) -> DataFrame:
    """One row of counters per column; the evidence ``detect`` turns into confidences.

    ``entities`` (of patterns, and NAME, SAUDI_ADDRESS, CITY and so on) leaves out
    the flags, and where names of columns decide also the columns, of all others.
    """
    columns = columns or profiled_columns(df, row_key)
    hints = hints_for(columns)
    if entities and entities <= _BY_HINT:
        columns = [c for c in columns if any(c in hints[e] for e in entities)]
    if not columns:
        columns, df = df.columns[:1], df.limit(0)
    long = cells(df, row_key, columns)
    # buffers of a fixed width are hashed; with texts in them, Spark would sort the cells
    numbered = row_key is not None and dict(df.dtypes)[row_key] == "string" and _fits_a_number(df, row_key)
    if numbered:
        long = long.withColumn("row_key", _number_of(F.col("row_key")))
    totals = _column_totals(_lane_totals(_cell_flags(long, hints, entities)))
    if numbered:
        totals = totals.withColumns({c: _text_of(F.col(c)) for c in totals.columns if c.endswith("_bound")})
    counted = sorted({c for e in ("CUSTOMER_ID", "GENDER") if entities is None or e in entities for c in hints[e]})
    if not counted:
        return totals.withColumn("distinct_n", F.lit(None).cast("bigint"))
    # one row per profiled column on both sides: the size is bounded by the header
    return totals.join(F.broadcast(distinct_counts(cells(df, row_key, counted), counted, approximate)), "column", "left")


# --------------------------------------------------------------------------- evidence to detections
# Written as SQL text over the counter columns: a share, a confidence and its
# reasons read much like the rule they state.

def _hint(hints: dict, group: str) -> str:
    cases = " ".join(f"when {sql_text(c)} then {sql_text(k)}" for c, k in hints[group].items())
    return f"(case column {cases} end)" if cases else "cast(null as string)"


def _say(template: str, **parts: str) -> str:
    """A worded template as SQL; ``parts`` are SQL expressions for its fields."""
    pieces = re.split(r"\{(\w+)\}", template)
    said = [parts[piece] if i % 2 else sql_text(piece) for i, piece in enumerate(pieces) if piece]
    return f"concat({', '.join(said)})"


def _share(part: str, whole: str) -> str:
    shown = f"cast(rint({part} * 100.0D / greatest({whole}, 1)) as bigint)"
    return _say(V.SHARE, part=part, whole=whole, percent=shown)


def _percent(rate: str) -> str:
    return f"concat(cast(rint(100D * ({rate})) as bigint), '%')"


def _named(hint: str) -> str:
    return f"if({hint} is not null, {_say(V.REASONS['hint'], keyword=hint)}, null)"


def _finding(entity: str, order: int, group: str, raw: str, reasons: list[str], wanted: str,
             embedded: str = "false") -> str:
    return (f"if({wanted}, named_struct('raw', {raw}, 'place', {order}, 'entity', {entity}, 'embedded', {embedded}, "
            f"'sample_group', '{group}', 'reasons', array_compact(array({', '.join(reasons)}))), null)")


def _pattern_finding(entity: str, order: int, hints: dict) -> str:
    s = _SHORT[entity]
    weight, check_weight, label = PATTERNS[entity].weights
    n, hits, valid, full, context = "n", f"{s}_n", f"{s}_valid_n", f"{s}_full_n", f"{s}_context_n"
    hint = _hint(hints, entity)
    embedded = f"({hits} > 0 and try_divide({full}, {hits}) < {V.EMBEDDED_BELOW}D)"
    rate = f"if({embedded}, least(1.0D, {hits} / {V.EMBEDDED_FULL_EVIDENCE}), {hits} / {n})"
    valid_rate = f"if({embedded}, try_divide({valid}, {hits}), {valid} / {n})"
    bonus = f"if(not {embedded} and try_divide({full}, {hits}) >= {V.FULL_MATCH_SHARE}D, {V.WHOLE_CELL_BONUS}D, 0D)"
    matched = (f"({weight}D * {rate} + {check_weight}D * {valid_rate} + {bonus}"
               f" + if({hint} is not null, {V.HINT_WEIGHT}D, 0D) + {V.CONTEXT_WEIGHT}D * try_divide({context}, {hits}))")
    raw = f"if({hits} > 0, {matched}, {V.HINT_WITHOUT_MATCH}D)"
    words = ", ".join(sql_text(k) for k in V.CONTEXT_KEYWORDS[entity])
    keyword = f"try_element_at(array({words}), {s}_place)"

    said, label = V.REASONS, sql_text(label)

    def when_hit(text: str, condition: str = "true") -> str:
        return f"if({hits} > 0 and {condition}, {text}, null)"
    where = f"if({embedded}, {sql_text(V.WHERE_EMBEDDED)}, {sql_text(V.WHERE_WHOLE)})"
    reasons = [
        f"if({hits} > 0, null, {_say(said['hint_without_match'], keyword=hint, label=label)})",
        when_hit(_say(said["pattern"], label=label, where=where, share=_share(hits, n)))]
    if PATTERNS[entity].validator:
        passed = _say(said["checksum"], label=label, share=_share(valid, hits))
        reasons.append(when_hit(f"if({valid} > 0, {passed}, {_say(said['no_checksum'], label=label)})"))
    reasons += [
        when_hit(_named(hint)),
        when_hit(_say(said["context"], keyword=keyword, share=_share(context, hits)), f"{context} > 0"),
        when_hit(_say(said["no_context"]), f"{hint} is null and {context} = 0")]
    return _finding(f"'{entity}'", order, s, raw, reasons, f"{hits} > 0 or {hint} is not null", embedded)


def _name_finding(order: int, hints: dict) -> str:
    hint = _hint(hints, "PERSON_NAME")
    before_hint = f"({V.NAME_SHAPE_WEIGHT}D * name_n / n + {V.NAME_LEXICON_WEIGHT}D * lexicon_n / n)"
    raw = f"{before_hint} + if({hint} is not null, {V.NAME_HINT_WEIGHT}D, 0D)"
    arabic_name = f"column rlike '[{V.ARABIC_BLOCK}]'"
    entity = (f"if(if(name_n > 0, try_divide(arabic_n, name_n) >= 0.5D, {arabic_name}), "
              "'ARABIC_PERSON_NAME', 'PERSON_NAME')")
    said = V.REASONS
    reasons = [
        f"if(name_n > 0, {_say(said['names'], share=_share('name_n', 'n'))}, null)",
        f"if(lexicon_n > 0, {_say(said['lexicon'], share=_share('lexicon_n', 'n'))}, null)",
        _named(hint),
        f"if({hint} is null and {before_hint} < {V.FLAG_AT}D, {_say(said['no_name_context'])}, null)"]
    return _finding(entity, order, "name", raw, reasons, f"name_n > 0 or {hint} is not null")


def _address_finding(order: int, hints: dict) -> str:
    hint, district = _hint(hints, "SAUDI_ADDRESS"), _hint(hints, "DISTRICT")
    raw = f"{V.ADDRESS_WEIGHT}D * address_n / n + if({hint} is not null, {V.ADDRESS_HINT_WEIGHT}D, 0D)"
    words = ", ".join(sql_text(k) for k in V.ADDRESS_KEYWORDS)
    found = f"slice(array_sort(filter(array({words}), (k, i) -> address_bits & shiftleft(1, i) > 0)), 1, 4)"
    named = _say(V.REASONS["address"], keywords=f"array_join({found}, ', ')", share=_share("address_n", "n"))
    reasons = [f"if(address_n > 0, {named}, null)", _named(hint)]
    return _finding("'SAUDI_ADDRESS'", order, "address", raw, reasons,
                    f"({hint} is not null or {district} is null) and (address_n > 0 or {hint} is not null)")


def _customer_id_finding(order: int, hints: dict) -> str:
    hint = _hint(hints, "CUSTOMER_ID")
    reasons = [_named(hint), _say(V.REASONS["unique"], percent=_percent("distinct_n / n"))]
    raw = f"{V.CUSTOMER_ID_BASE}D + {V.CUSTOMER_ID_UNIQUE_WEIGHT}D * (distinct_n / n)"
    return _finding("'CUSTOMER_ID'", order, "any", raw, reasons, f"{hint} is not null")


def _indirect_finding(entity: str, order: int, hints: dict) -> str:
    gender_rate = f"if(distinct_n <= {V.GENDER_MAX_VALUES}, 1D, 0D)"
    checks = {      # share of values that look right, and how it is reported
        "AGE": ("age_n / n", "age"), "SALARY": ("number_n / n", "salary"), "DATE_OF_BIRTH": ("date_n / n", "dates"),
        "CITY": ("city_n / n", "cities"), "GENDER": (gender_rate, "gender")}
    hint = _hint(hints, entity)
    raw, wanted = f"if({hint} is not null, {V.INDIRECT_HINT}D, 0D)", f"{hint} is not null"
    reasons = [_named(hint)]
    if entity in checks:
        rate, reason = checks[entity]
        said = _say(V.REASONS[reason], percent=_percent(rate), distinct="distinct_n")
        raw += f" + if({hint} is not null, {V.INDIRECT_CHECK}D, {V.INDIRECT_CHECK_ALONE}D) * ({rate})"
        reasons.append(f"if({rate} > 0, {said}, null)")
        if entity == "CITY":
            wanted += f" or {rate} >= {V.CITY_SHARE_WITHOUT_HINT}D"
    reasons.append(_say(V.REASONS["indirect"]))
    return _finding(f"'{entity}'", order, "any", raw, reasons, wanted)


def _other_findings(hints: dict) -> list[str]:
    found = {"NAME": _name_finding, "SAUDI_ADDRESS": _address_finding, "CUSTOMER_ID": _customer_id_finding}
    return [found[e](i, hints) if e in found else _indirect_finding(e, i, hints)
            for i, e in enumerate(_OTHER_ORDER, start=len(PATTERNS))]


def findings_from_profile(profile: DataFrame, columns: list[str], every: bool = False) -> DataFrame:
    """Detections from the counters of ``profile_columns``.

    Per column: every pattern finding and the single best of the others (highest
    confidence, direct before indirect, then the fixed order).  ``every`` keeps
    all the others too.
    """
    hints = hints_for(columns)
    patterns = [_pattern_finding(e, i, hints) for i, e in enumerate(PATTERNS)]
    found = profile.selectExpr(
        "column", f"inline(array_compact(array({', '.join(patterns + _other_findings(hints))})))")
    entity, confidence = F.col("entity"), F.col("confidence")
    rated = found.withColumn("confidence", round_exact(F.least(F.col("raw"), F.lit(V.CONFIDENCE_CAP)), 2)).withColumn(
        "category", category_of(entity))
    if not every:
        rated = _keep_best(rated)
    position = F.expr(f"cast(array_position(array({', '.join(map(sql_text, columns))}), column) as int) - 1")
    return rated.select(
        position.alias("position"), "place", "column", "entity", "category", "confidence",
        lower_risk(base_risk_of(entity), confidence).alias("risk"), "reasons",
        F.lit(V.ENGINE).alias("engine"), "embedded", (confidence >= V.FLAG_AT).alias("flagged"),
        label_of(entity).alias("label"))


def _keep_best(rated: DataFrame) -> DataFrame:
    ranked = rated.selectExpr(
        "*", f"row_number() over (partition by column, place >= {len(PATTERNS)} "
             "order by confidence desc, category = 'Direct' desc, place) as nth")
    return ranked.where((F.col("place") < len(PATTERNS)) | (F.col("nth") == 1)).drop("nth")


def detect(df: DataFrame, row_key: str | None = None, columns: list[str] | None = None,
           approximate: bool = False) -> DataFrame:
    """All detections of a table, one row per column and entity."""
    columns = columns or profiled_columns(df, row_key)
    profile = profile_columns(df, row_key, columns, approximate)
    return findings_from_profile(profile, columns)


def explain(df: DataFrame, row_key: str, columns: list[str] | None = None) -> DataFrame:
    """``detect`` with the first three values behind each detection, by row key.

    The counters say how far, in row-key order, the first three values of each
    group can lie; the second pass reads only rows up to there.
    """
    columns = columns or profiled_columns(df, row_key)
    profile = stage(profile_columns(df, row_key, columns), "profile")
    found = findings_from_profile(profile, columns)
    # as many rows as the header has columns
    rows = profile.select("column", "n", *[f"{g}_n" for g in _GROUPS if g != "any"],
                          *[f"{g}_bound" for g in _GROUPS]).collect()
    values = first_values(df, row_key, columns, rows)
    grouped = found.withColumn("sample_group", _sample_group(F.col("entity")))
    short = F.transform("values", lambda v: F.substring(v, 1, SAMPLE_LENGTH))
    return (grouped.join(F.broadcast(values), ["column", "sample_group"], "left")
            .withColumn("samples", F.coalesce(
                F.when(F.col("sample_group").isin(list(_SHORT.values())), short).otherwise(F.col("values")),
                F.array().cast("array<string>")))
            .drop("values", "sample_group"))


def _sample_group(entity: Column) -> Column:
    group = F.lit("any")
    for name, short in {**_SHORT, "ARABIC_PERSON_NAME": "name", "PERSON_NAME": "name",
                        "SAUDI_ADDRESS": "address"}.items():
        group = F.when(entity == name, short).otherwise(group)
    return group


def first_values(df: DataFrame, row_key: str, columns: list[str], rows: list) -> DataFrame:
    """First three values, by row key, of each (column, group) that has any."""
    wanted = {(r["column"], g): r[f"{g}_bound"] for r in rows for g in _GROUPS if g == "any" or r[f"{g}_n"] > 0}
    if wanted and None not in wanted.values():
        df = df.where(named(row_key) <= F.lit(max(wanted.values())))
    long = cells(df, row_key, columns)
    reach: dict = {}
    for (c, _), b in wanted.items():
        reach[c] = None if b is None or c in reach and reach[c] is None else max(b, reach.get(c, b))
    if reach and None not in reach.values():        # a column's cells beyond its own bound are not looked at
        known = df.sparkSession.createDataFrame(list(reach.items()), T.StructType([
            T.StructField("column", T.StringType()), T.StructField("reach", df.schema[row_key].dataType)]))
        long = long.join(F.broadcast(known), "column").where("row_key <= reach").drop("reach")
    flags = _cell_flags(long, hints_for(columns))
    # (column, group, bound) is as long as the header; broadcasting it keeps the cells where they are
    bounds = df.sparkSession.createDataFrame(
        [(c, g, b) for (c, g), b in wanted.items()],
        T.StructType([T.StructField("column", T.StringType()), T.StructField("sample_group", T.StringType()),
                      T.StructField("bound", df.schema[row_key].dataType)]))
    tests = ", ".join(f"if({g}_hit, '{g}', null)" for g in _GROUPS)
    hit = flags.selectExpr("row_key", "column", "value", f"explode(array_compact(array({tests}))) as sample_group")
    marked = hit.join(F.broadcast(bounds), ["column", "sample_group"]).where("bound is null or row_key <= bound")
    # three rows per group: row_number below a constant is also cut before the shuffle
    ranked = marked.selectExpr(
        "*", "row_number() over (partition by column, sample_group order by row_key) as nth").where(f"nth <= {SAMPLES}")
    firsts = ranked.groupBy("column", "sample_group").agg(
        F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("firsts"))
    return firsts.select("column", "sample_group", F.col("firsts.value").alias("values"))


# --------------------------------------------------------------------------- views over detections
def flagged(detections: DataFrame) -> DataFrame:
    return detections.where("flagged")


def candidates(detections: DataFrame) -> DataFrame:
    """Below the flagging threshold but worth showing."""
    return detections.where(~F.col("flagged") & (F.col("confidence") >= V.CANDIDATE_AT))


def by_category(detections: DataFrame, category: str) -> DataFrame:
    return detections.where(F.col("flagged") & (F.col("category") == category))


def by_entity_risk(detections: DataFrame) -> DataFrame:
    return flagged(detections).groupBy("label", "risk").agg(F.count("*").alias("findings"))


def dataset_summary(df: DataFrame, detections: DataFrame, columns: int) -> DataFrame:
    """One row: records, columns, and columns flagged / direct / indirect / high risk."""
    def distinct(condition):
        return F.count_distinct(F.when(condition, F.col("column")))
    f = F.col("flagged")
    counts = detections.agg(
        distinct(f).alias("sensitive_fields"),
        distinct(f & (F.col("category") == "Direct")).alias("direct"),
        distinct(f & (F.col("category") == "Indirect")).alias("indirect"),
        distinct(f & (F.col("risk") == "HIGH")).alias("high_risk"))
    records = df.agg(F.count("*").alias("records"), F.lit(columns).cast("bigint").alias("columns"))
    return records.crossJoin(F.broadcast(counts))      # one row on each side
