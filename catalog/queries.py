"""One query per operator, over the supplied tables and views derived from them."""

from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

import veilframe as vf
from catalog.subjects import COLUMNS, subjects
from veilframe.functions import checks, fakes, masks, numbers, spans, text
from veilframe.operators import corpus, detect, lookup, report, risk, scoring, treat, utility
from veilframe.operators.book import PseudonymBook
from veilframe.plans import anonymize, config, profiles
from veilframe.session import spread, stage, work_folder
from veilframe.sources import readers, writers
from veilframe.streaming import mask_stream

KEY = "c_custkey"
SALT = "pepper"
SHORT = 10         # hexadecimal characters of a pseudonym, the short form
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --------------------------------------------------------------------------- shared inputs
@cache
def _staged(spark: SparkSession, sf_dir: str, what: str, profile: str = ""):
    """Steps that several queries start from, written once per session."""
    if what == "subjects":
        return stage(_subjects(spark, sf_dir), what)
    people = _staged(spark, sf_dir, "subjects")
    if what == "detections":
        return stage(detect.detect(people, KEY), what)
    if what == "profile":
        return stage(detect.profile_columns(people, KEY), what)
    found = _staged(spark, sf_dir, "detections")
    planned = config.build_config(found, COLUMNS, profile)
    if what == "anonymized":
        return anonymize.anonymize(people, planned, found, profile, KEY, SALT, hash_length=SHORT)
    if what == "counters":
        return scoring.measure(_staged(spark, sf_dir, "anonymized", profile))
    raise KeyError(what)


def people(spark, sf_dir):
    return _staged(spark, sf_dir, "subjects")


def table(spark, sf_dir, name):
    return readers.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _subjects(spark, sf_dir):
    """The subjects, made and later read by all cores however the customer file is cut."""
    return subjects(spread(table(spark, sf_dir, "customer")))


def card(spark, sf_dir):
    """The identifiers and the note of a subject as one text."""
    fields = ["notes", "national_id", "mobile", "iban", "email", "order_ref"]
    return people(spark, sf_dir).select(KEY, F.concat_ws(" | ", *fields).alias("card"))


def texts(spark, sf_dir):
    """Every free text there is: documents, pages, conversations, notes and cards."""
    parts = [
        table(spark, sf_dir, "documents").select(F.concat(F.lit("document "), "doc_id").alias("id"), "text"),
        table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("id"), F.col("html").alias("text")),
        table(spark, sf_dir, "conversations").select(
            F.concat(F.lit("turn "), "conv_id", F.lit("."), "turn").alias("id"), "text"),
        people(spark, sf_dir).select(F.concat(F.lit("note "), KEY).alias("id"), F.col("notes").alias("text")),
        card(spark, sf_dir).select(F.concat(F.lit("card "), KEY).alias("id"), F.col("card").alias("text"))]
    return reduce(DataFrame.unionByName, parts)


def _found_columns(df):
    return df.select("column", "entity", "category", "confidence", "risk", "embedded", "flagged")


def _detections(spark, sf_dir):
    return _staged(spark, sf_dir, "detections")


def _finding(spark, sf_dir, *entities):
    every = detect.findings_from_profile(
        detect.profile_columns(people(spark, sf_dir), KEY, entities={"NAME" if e.endswith("PERSON_NAME") else e for e in entities}),
        COLUMNS, every=True)
    return _found_columns(every.where(F.col("entity").isin(*entities)))


def _anonymized(spark, sf_dir, profile="external"):
    return _staged(spark, sf_dir, "anonymized", profile)


def _config(spark, sf_dir, profile="external"):
    return config.build_config(_detections(spark, sf_dir), COLUMNS, profile)


def _words(c):
    return F.array_join(c, "|")


# --------------------------------------------------------------------------- sources and sinks
def _folder(spark, name):
    import uuid
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def src_csv_text(spark, sf_dir):
    path = _folder(spark, "csv")
    writers.write_csv(people(spark, sf_dir), path)
    return readers.read_csv(spark, path)


@query
def src_encoding_audit(spark, sf_dir):
    path = _folder(spark, "encodings")
    names = people(spark, sf_dir).select(F.col(KEY).cast("string").alias(KEY), "customer_name_ar")
    even = F.col(KEY).cast("bigint") % 2 == 0
    names.where(even).write.option("header", True).csv(f"{path}/utf8")
    (names.where(~even).withColumn("customer_name_ar", readers.to_code_page(F.col("customer_name_ar")))
     .write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/arabic"))
    return readers.read_csv_folder(spark, f"{path}/*/*.csv")


@query
def sink_csv(spark, sf_dir):
    path = _folder(spark, "out")
    writers.write_csv(_anonymized(spark, sf_dir).data, path)
    return readers.read_csv(spark, path)


@query
def sink_parquet(spark, sf_dir):
    path = _folder(spark, "run")
    result, counters = _anonymized(spark, sf_dir), _staged(spark, sf_dir, "counters", "external")
    writers.save_run(path, _detections(spark, sf_dir), _config(spark, sf_dir), result,
                     risk.assess_risk(result, counters), utility.assess_utility(result, counters))
    return writers.load_run(spark, path)["data"]


# --------------------------------------------------------------------------- predicates and projections
@query
def flagged_findings(spark, sf_dir):
    return _found_columns(detect.flagged(_detections(spark, sf_dir)))


@query
def candidate_findings(spark, sf_dir):
    return _found_columns(detect.candidates(_detections(spark, sf_dir)))


@query
def risk_level_of(spark, sf_dir):
    found = _detections(spark, sf_dir)
    base = corpus.base_risk_of(F.col("entity"))
    return found.select("column", "entity", base.alias("base_risk"),
                        corpus.lower_risk(base, F.col("confidence")).alias("risk"))


@query
def kept_direct(spark, sf_dir):
    kept = {"email": "Keep", "customer_name_en": "Keep", "mobile": "Keep"}
    changed = config.override_config(_config(spark, sf_dir, "internal"), kept)
    return config.kept_direct(changed).select("column", "category", "method")


@query
def remaining_direct(spark, sf_dir):
    plan = config.override_config(_config(spark, sf_dir, "internal"), {"email": "Keep", "customer_name_en": "Keep"})
    result = anonymize.anonymize(people(spark, sf_dir), plan, _detections(spark, sf_dir), "internal", KEY, SALT, hash_length=SHORT)
    scored = risk.assess_risk(result).exposure_table(spark)
    return scored.where("exposure_after >= 0.5").select("column", "method", "exposure_after")


@query
def changed_columns(spark, sf_dir):
    return scoring.changed_columns(_anonymized(spark, sf_dir).paired, COLUMNS)


@query
def preview_head(spark, sf_dir):
    return scoring.preview(_anonymized(spark, sf_dir), ["mobile", "salary", "city"], 12)


@query
def findings_by_category(spark, sf_dir):
    found = _detections(spark, sf_dir)
    both = vf.by_category(found, "Direct").unionByName(vf.by_category(found, "Indirect"))
    return both.groupBy("category").agg(F.count("*").alias("findings"), F.max("confidence").alias("highest"))


# --------------------------------------------------------------------------- scalars
@query
def normalize_digits(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[
        text.normalize_digits(F.col(c)).alias(c) for c in ("national_id", "mobile", "notes")])


@query
def normalize_arabic(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[
        text.fold_arabic(F.col(c)).alias(c) for c in ("customer_name_ar", "customer_name_en", "address_ar", "city", "notes")])


@query
def name_tokens(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[
        _words(text.name_tokens(F.col(c))).alias(c) for c in ("customer_name_ar", "customer_name_en", "address_ar")])


@query
def column_hints(spark, sf_dir):
    """What the headers say, beside how many cells of the column are filled."""
    rows = [(c, g, k) for g, found in detect.hints_for(COLUMNS).items() for c, k in found.items()]
    filled = detect.cells(people(spark, sf_dir), KEY, COLUMNS).groupBy("column").agg(F.count("*").alias("filled"))
    return spark.createDataFrame(rows, "column string, entity string, keyword string").join(filled, "column")


@query
def context_keyword(spark, sf_dir):
    found = corpus.text_spans(texts(spark, sf_dir), "id", "text")
    word = F.lit(None).cast("string")
    for entity in spans.PATTERNS:
        word = F.when(F.col("entity") == entity,
                      text.context_keyword(F.col("plain"), F.col("start"), F.col("end"), entity)).otherwise(word)
    return found.select("id", "entity", "start", word.alias("keyword"))


@query
def parse_number(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[
        numbers.parse_number(F.col(c)).alias(c) for c in ("age", "salary", "mobile", "birth_date", "national_id")])


@query
def band_midpoint(spark, sf_dir):
    data = _anonymized(spark, sf_dir).data
    return data.select(KEY, numbers.band_midpoint(F.col("age")).alias("age"),
                       numbers.band_midpoint(F.col("salary")).alias("salary"),
                       numbers.band_midpoint(F.col("monthly_spending")).alias("monthly_spending"))


def _audit(spark, sf_dir, columns, valid):
    long = detect.cells(people(spark, sf_dir), KEY, columns)
    return long.groupBy("column").agg(F.count("*").alias("filled"), F.count_if(valid(F.col("value"))).alias("valid"))


@query
def id_checksum_audit(spark, sf_dir):
    return _audit(spark, sf_dir, COLUMNS, checks.national_id_valid)


@query
def iban_checksum_audit(spark, sf_dir):
    return _audit(spark, sf_dir, COLUMNS, checks.iban_valid)


@query
def name_shape(spark, sf_dir):
    long = detect.cells(people(spark, sf_dir), KEY, COLUMNS)
    return long.select(F.col("row_key").alias(KEY), "column", text.name_shape(F.col("value")).alias("s")).select(
        KEY, "column", "s.*")


@query
def is_known_city(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, "city", text.is_known_city(F.col("city")).alias("known"))


@query
def address_keywords(spark, sf_dir):
    long = detect.cells(people(spark, sf_dir), KEY, COLUMNS)
    found = text.address_keywords(F.col("value"))
    return long.select(F.col("row_key").alias(KEY), "column", _words(found).alias("keywords"),
                       ((F.size(found) > 0) & (F.length("value") >= 10)).alias("is_address"))


# --------------------------------------------------------------------------- spans
def _spans_of(df, key, column, entity):
    return corpus.text_spans(df, key, column, [entity]).select(key, "start", "end", "frag")


@query
def spans_national_id(spark, sf_dir):
    return _spans_of(texts(spark, sf_dir), "id", "text", "SAUDI_NATIONAL_ID")


@query
def spans_mobile(spark, sf_dir):
    return _spans_of(texts(spark, sf_dir), "id", "text", "SAUDI_MOBILE")


@query
def spans_iban(spark, sf_dir):
    return _spans_of(texts(spark, sf_dir), "id", "text", "SAUDI_IBAN")


@query
def spans_email(spark, sf_dir):
    return _spans_of(texts(spark, sf_dir), "id", "text", "EMAIL_ADDRESS")


@query
def corpus_findings(spark, sf_dir):
    return corpus.corpus_findings(texts(spark, sf_dir), "id", "text")


@query
def resolve_overlaps(spark, sf_dir):
    plain = texts(spark, sf_dir).select("id", text.normalize_digits(F.col("text")).alias("plain")).where(
        spans.may_hold_spans(F.col("plain")))
    kept = F.explode_outer(spans.resolve_overlaps(spans.all_spans(F.col("plain"))))
    return plain.select("id", kept.alias("span")).where("span is not null").select(
        "id", "span.start", "span.end", "span.entity")


# --------------------------------------------------------------------------- detection
@query
def detect_pattern(spark, sf_dir):
    return _finding(spark, sf_dir, *spans.PATTERNS)


@query
def detect_name(spark, sf_dir):
    return _finding(spark, sf_dir, "PERSON_NAME", "ARABIC_PERSON_NAME")


@query
def detect_address(spark, sf_dir):
    return _finding(spark, sf_dir, "SAUDI_ADDRESS")


@query
def detect_customer_id(spark, sf_dir):
    return _finding(spark, sf_dir, "CUSTOMER_ID")


@query
def detect_age(spark, sf_dir):
    return _finding(spark, sf_dir, "AGE")


@query
def detect_salary(spark, sf_dir):
    return _finding(spark, sf_dir, "SALARY")


@query
def detect_birth_date(spark, sf_dir):
    return _finding(spark, sf_dir, "DATE_OF_BIRTH")


@query
def detect_city(spark, sf_dir):
    return _finding(spark, sf_dir, "CITY")


@query
def detect_gender(spark, sf_dir):
    return _finding(spark, sf_dir, "GENDER")


@query
def detect_hint_only(spark, sf_dir):
    return _finding(spark, sf_dir, "DISTRICT", "JOB_TITLE", "NATIONALITY")


@query
def detect_table(spark, sf_dir):
    return _found_columns(detect.detect(_subjects(spark, sf_dir), KEY))


@query
def explain_findings(spark, sf_dir):
    found = vf.explain(people(spark, sf_dir), KEY)
    return found.select("column", "entity", "confidence", _words("reasons").alias("reasons"),
                        _words("samples").alias("samples"))


@query
def dataset_summary(spark, sf_dir):
    return vf.dataset_summary(people(spark, sf_dir), _detections(spark, sf_dir), len(COLUMNS))


@query
def findings_by_entity_risk(spark, sf_dir):
    return vf.by_entity_risk(_detections(spark, sf_dir))


# --------------------------------------------------------------------------- planning
@query
def recommend_methods(spark, sf_dir):
    plans = [_config(spark, sf_dir, p).withColumn("profile", F.lit(p)) for p in vf.PROFILES]
    return reduce(DataFrame.unionByName, plans).select(
        "profile", "column", "detected", "confidence", "category", "recommended")


@query
def resolve_column_entities(spark, sf_dir):
    return config.column_entities(_detections(spark, sf_dir)).select(
        "column", _words("entities").alias("entities"), "embedded")


@query
def override_config(spark, sf_dir):
    changed = config.override_config(_config(spark, sf_dir), {"mobile": "Suppression", "gender": "Hashing"},
                                     {"monthly_spending": "Indirect", "notes": "Non-sensitive"})
    return changed.select("column", "recommended", "method", "category")


@query
def explain_methods(spark, sf_dir):
    """Why each column is treated as it is, under each purpose."""
    rows = [config.explain_config(_config(spark, sf_dir, p)).select(F.lit(p).alias("profile"), F.lit(profile.description).alias("purpose"), "column", "method", "reason")
            for p, profile in profiles.PROFILES.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def purpose_profiles(spark, sf_dir):
    """Each purpose's settings, beside what it does to the columns of the table."""
    plans = [_config(spark, sf_dir, p).select(F.lit(p).alias("profile"), "method") for p in profiles.PROFILES]
    used = reduce(DataFrame.unionByName, plans).groupBy("profile").agg(
        F.count_if(F.col("method") != "Keep").alias("treated"), F.count_if(F.col("method") == "Suppression").alias("suppressed"))
    return profiles.profiles_table(spark).join(used, "profile")


# --------------------------------------------------------------------------- treatments
def _both(f, c):
    return [f(F.col(c), "strong").alias("strong"), f(F.col(c), "medium").alias("medium")]


@query
def mask_generic(spark, sf_dir):
    long = detect.cells(people(spark, sf_dir), KEY, COLUMNS)
    return long.select(F.col("row_key").alias(KEY), "column", *_both(masks.mask_generic, "value"))


@query
def mask_national_id(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *_both(masks.mask_national_id, "national_id"))


@query
def mask_mobile(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *_both(masks.mask_mobile, "mobile"))


@query
def mask_iban(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *_both(masks.mask_iban, "iban"))


@query
def mask_email(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *_both(masks.mask_email, "email"))


@query
def mask_person_name(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[
        masks.mask_person_name(F.col(c)).alias(c) for c in ("customer_name_ar", "customer_name_en")])


@query
def mask_free_text(spark, sf_dir):
    return corpus.mask_text(texts(spark, sf_dir), "text", "medium")


@query
def suppress(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[treat.suppress(F.col(c)).alias(c) for c in ("national_id", "notes", "iban")])


@query
def hash_pseudonym(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, *[
        treat.hash_value(F.col(c), SALT, SHORT).alias(c) for c in ("customer_id", "national_id", "city")])


@query
def replace_sequential(spark, sf_dir):
    df = people(spark, sf_dir).select(KEY, "customer_name_ar", "national_id", "job")
    columns = {"customer_name_ar": "ARABIC_PERSON_NAME", "national_id": "SAUDI_NATIONAL_ID", "job": "JOB_TITLE"}
    numbers_of = stage(lookup.first_seen_numbers(df, KEY, list(columns)), "numbers")
    df = lookup.attach_numbers(df, KEY, list(columns), numbers_of)
    return df.select(KEY, *[treat.replace_numbered(F.col(c), F.col(f"__number_{c}"), e, False).alias(c)
                            for c, e in columns.items()])


@query
def replace_format_preserving(spark, sf_dir):
    """How many fakes are valid, keep their prefix, and keep their length."""
    df = people(spark, sf_dir)
    made = {"national_id": fakes.fake_national_id, "mobile": fakes.fake_mobile, "iban": fakes.fake_iban,
            "customer_name_ar": fakes.fake_name, "customer_name_en": fakes.fake_name}
    faked = df.select(KEY, *made, *[F.when(F.trim(c) != "", f(F.col(c), SALT)).otherwise(F.col(c)).alias(f"{c}_fake") for c, f in made.items()])
    digits = text.normalize_digits(F.col("mobile"))
    words = lambda c: F.size(F.split(c, " "))
    return faked.agg(
        F.count_if(checks.national_id_valid(F.col("national_id_fake"))).alias("valid_ids"),
        F.count_if(F.substring(text.normalize_digits(F.col("national_id")), 1, 1)
                   == F.substring("national_id_fake", 1, 1)).alias("ids_of_same_kind"),
        F.count_if(F.regexp_replace(digits, "[0-9]", "#") == F.regexp_replace("mobile_fake", "[0-9]", "#")).alias("mobiles_of_same_form"),
        F.count_if(F.regexp_extract(digits, "^[^5]*5", 0) == F.regexp_extract("mobile_fake", "^[^5]*5", 0)).alias("mobiles_of_same_prefix"),
        F.count_if(checks.iban_valid(F.col("iban_fake"))).alias("valid_ibans"),
        F.count_if(F.length("iban") == F.length("iban_fake")).alias("ibans_of_same_form"),
        F.count_if(text.has_arabic(F.col("customer_name_ar_fake"))).alias("arabic_names"),
        F.count_if(~text.has_arabic(F.col("customer_name_en_fake"))).alias("latin_names"),
        F.count_if(words(F.col("customer_name_en")) == words(F.col("customer_name_en_fake"))).alias("names_of_same_size"))


@query
def replace_format_preserving_rows(spark, sf_dir):
    """The fakes themselves: different identifiers get different ones."""
    kinds = {"national_id": "SAUDI_NATIONAL_ID", "mobile": "SAUDI_MOBILE", "iban": "SAUDI_IBAN",
             "customer_name_ar": "ARABIC_PERSON_NAME", "customer_name_en": "PERSON_NAME"}
    return people(spark, sf_dir).select(KEY, *[treat.replace_stateless(F.col(c), e, SALT).alias(c) for c, e in kinds.items()])


def _widths(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int"), F.col("l_extendedprice").cast("bigint"))
    parts = [people(spark, sf_dir).select("age", "salary", "monthly_spending"), wide,
             table(spark, sf_dir, "part").select("p_size")]
    figures = [treat.column_figures(p, p.columns) for p in parts]
    return reduce(DataFrame.unionByName, figures)


@query
def choose_band_width(spark, sf_dir):
    figures = _widths(spark, sf_dir)
    widths = [numbers.nearest_width(F.col("low"), F.col("high"), F.lit(p.target_bins)).alias(p.key)
              for p in vf.PROFILES.values()]
    return figures.select("column", "low", "high", *widths)


@query
def generalize_numeric(spark, sf_dir):
    return people(spark, sf_dir).select(
        KEY, treat.generalize_numeric(F.col("age"), F.lit(5.0)).alias("age"),
        treat.generalize_numeric(F.col("salary"), F.lit(1000.0)).alias("salary"))


@query
def generalize_date(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", treat.generalize_date(day, True).alias("decade"), treat.generalize_date(day, False).alias("year"))


@query
def generalize_city_region(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, "city", treat.city_region(F.col("city")).alias("region"))


def _merged(df, key, columns, frac):
    present = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    kept = {c: [] for c in columns}
    for r in treat.common_categories(df, present, frac).collect():      # at most 1/frac per column
        kept[r["column"]].append(r["value"])
    return df.select(key, *[treat.merge_rare(F.col(c), sorted(kept[c])).alias(c) for c in columns])


@query
def merge_rare_categories(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return _merged(part, "p_partkey", ["p_brand", "p_type"], 0.05)


@query
def generalize_address(spark, sf_dir):
    return people(spark, sf_dir).select(KEY, treat.generalize_address(F.col("address_ar")).alias("address_ar"))


@query
def column_kind(spark, sf_dir):
    figures = treat.column_figures(people(spark, sf_dir), COLUMNS)
    return treat.column_kinds(figures).select("column", "filled", "numbers", "dates", "kind")


@query
def anonymize_table(spark, sf_dir):
    found = _detections(spark, sf_dir)
    return anonymize.anonymize(people(spark, sf_dir), _config(spark, sf_dir), found, "external", KEY, SALT, hash_length=SHORT).data


@query
def anonymize_table_internal(spark, sf_dir):
    return _anonymized(spark, sf_dir, "internal").data


# --------------------------------------------------------------------------- risk
@query
def visible_fraction(spark, sf_dir):
    paired = _anonymized(spark, sf_dir, "internal").paired
    masked = ["national_id", "mobile", "email", "iban"]
    pairs = scoring.stack_pairs(paired, masked)
    shown = scoring.visible_fraction(F.col("before"), F.col("after"))
    return pairs.groupBy("column").agg(F.round(F.avg(shown), 9).alias("visible"))


@query
def residual_pii_ratio(spark, sf_dir):
    counters = scoring.pair_counters(_anonymized(spark, sf_dir).paired, ["notes", "order_ref"], [], ["notes", "order_ref"], [])
    return counters.select("column", "found_before", "found_after", F.round(F.coalesce(F.least(
        F.lit(1.0), F.try_divide("found_after", "found_before")), F.lit(0.0)), 9).alias("ratio"))


def _risk(spark, sf_dir, profile="external"):
    return risk.assess_risk(_anonymized(spark, sf_dir, profile), _staged(spark, sf_dir, "counters", profile))


@query
def column_exposure(spark, sf_dir):
    return _risk(spark, sf_dir).exposure_table(spark).select("column", "method", "weight", "exposure_after")


@query
def direct_risk(spark, sf_dir):
    return _risk(spark, sf_dir).table(spark).select(
        F.round("direct_before", 9).alias("direct_before"), F.round("direct_after", 9).alias("direct_after"))


ORDER_QUASI = ["o_orderstatus", "o_orderpriority", "order_year", "order_month", "price_band"]
LINE_QUASI = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "ship_month"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"), F.floor(F.col("o_totalprice") / 50000).alias("price_band"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity"),
        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"))


@query
def quasi_risk(spark, sf_dir):
    rows = []
    for name, df, columns in (("orders", _orders(spark, sf_dir), ORDER_QUASI), ("lineitem", _lines(spark, sf_dir), LINE_QUASI)):
        classes = stage(risk.classes(df, columns), "classes")
        total = risk.k_anonymity(classes).select("rows")
        rows.append(risk.subset_classes(classes, columns).crossJoin(F.broadcast(total)).select(
            F.lit(name).alias("source"), "subset", "classes",
            F.round(F.col("classes") / F.col("rows"), 9).alias("average_risk")))
    return reduce(DataFrame.unionByName, rows)


@query
def k_anonymity(spark, sf_dir):
    rows = [risk.k_anonymity(risk.classes(df, columns)).withColumn("source", F.lit(name))
            for name, df, columns in (("orders", _orders(spark, sf_dir), ORDER_QUASI),
                                      ("lineitem", _lines(spark, sf_dir), LINE_QUASI))]
    return reduce(DataFrame.unionByName, rows).select(
        "source", "k", F.round("unique_share", 9).alias("unique_share"), "rows", "classes")


@query
def class_size_per_row(spark, sf_dir):
    return risk.class_size_per_row(_orders(spark, sf_dir), "o_orderkey", ORDER_QUASI[:3]).select("o_orderkey", "class_size")


@query
def risk_score(spark, sf_dir):
    result = _anonymized(spark, sf_dir)
    scored = risk.assess_risk(result).table(spark)
    exact = [c for c, t in scored.dtypes if t == "double"]
    return scored.select(*[F.round(c, 9).alias(c) if c in exact else F.col(c) for c in scored.columns])


# --------------------------------------------------------------------------- utility
def _utility(spark, sf_dir, profile="external"):
    return utility.assess_utility(_anonymized(spark, sf_dir, profile), _staged(spark, sf_dir, "counters", profile))


@query
def columns_preserved(spark, sf_dir):
    return _utility(spark, sf_dir).table(spark).select(F.round("A", 9).alias("columns_preserved"))


@query
def cells_preserved(spark, sf_dir):
    return _utility(spark, sf_dir).table(spark).select(F.round("B", 9).alias("cells_preserved"))


def _utility_columns(spark, sf_dir, figure):
    rows = [_utility(spark, sf_dir, p).column_table(spark).where("role = 'Analytical'").withColumn("profile", F.lit(p))
            for p in vf.PROFILES]
    return reduce(DataFrame.unionByName, rows).where(F.col(figure).isNotNull()).select("profile", "column", figure)


@query
def numeric_precision(spark, sf_dir):
    return _utility_columns(spark, sf_dir, "numeric_precision")


@query
def type_preservation(spark, sf_dir):
    return _utility_columns(spark, sf_dir, "type_kept")


@query
def numeric_distribution(spark, sf_dir):
    rows = []
    for p in vf.PROFILES:
        counters = _staged(spark, sf_dir, "counters", p)
        rows += [(p, c, round(utility.numeric_distribution(counters[c]), 9)) for c in ("age", "salary")]
    return spark.createDataFrame(rows, "profile string, column string, distribution double")


@query
def category_distribution(spark, sf_dir):
    return _utility_columns(spark, sf_dir, "distribution_kept").where(~F.col("column").isin("age", "salary"))


@query
def utility_score(spark, sf_dir):
    scored = utility.assess_utility(_anonymized(spark, sf_dir)).table(spark)
    return scored.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in scored.dtypes])


# --------------------------------------------------------------------------- report
@query
def recommendations(spark, sf_dir):
    rows = []
    for p in vf.PROFILES:
        result = _anonymized(spark, sf_dir, p)
        lines = report.recommendations(result, _risk(spark, sf_dir, p), _utility(spark, sf_dir, p))
        rows += [(p, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "profile string, line_no int, text string")


@query
def privacy_report(spark, sf_dir):
    from datetime import datetime
    result = _anonymized(spark, sf_dir)
    return report.privacy_report(result, _detections(spark, sf_dir), _risk(spark, sf_dir), _utility(spark, sf_dir),
                                 "subjects", people(spark, sf_dir).count(), datetime(2026, 1, 1))


@query
def outcome_verdict(spark, sf_dir):
    rows = [(p, report.verdict(_risk(spark, sf_dir, p), _utility(spark, sf_dir, p))) for p in vf.PROFILES]
    return spark.createDataFrame(rows, "profile string, verdict string")


@query
def compare_profiles(spark, sf_dir):
    compared = report.compare_profiles(people(spark, sf_dir), _detections(spark, sf_dir), COLUMNS, KEY, SALT)
    return compared.select("profile", *[F.round(c, 9).alias(c) for c in ("risk_before", "risk_after", "utility")],
                           "k_after", "level_before", "level_after")


# --------------------------------------------------------------------------- streams
@query
def stream_mask(spark, sf_dir):
    """The masked stream of all texts, after it has been written."""
    source, out = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    texts(spark, sf_dir).write.parquet(source)
    arriving = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 8).parquet(source)
    masked = mask_stream.masked_stream(arriving, "text", "medium")
    mask_stream.write_available(masked, out, _folder(spark, "stream-state")).start().awaitTermination()
    return spark.read.parquet(out)


@query
def stream_findings(spark, sf_dir):
    """The findings of the stream of all texts, after they have been written."""
    source, out = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    texts(spark, sf_dir).write.parquet(source)
    arriving = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 8).parquet(source)
    found = mask_stream.findings_stream(arriving, "id", "text")
    mask_stream.write_available(found, out, _folder(spark, "stream-state")).start().awaitTermination()
    return spark.read.parquet(out)


@query
def stream_treated(spark, sf_dir):
    """All subjects as a stream, names numbered on from a table of every second subject."""
    result = _anonymized(spark, sf_dir, "internal")
    book = PseudonymBook(spark, _folder(spark, "book"), SALT)
    book.extend(people(spark, sf_dir).where(F.col(KEY) % 2 == 0), KEY, anonymize.numbered_columns(result.treatments, result.profile))
    source, out = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    people(spark, sf_dir).write.parquet(source)
    arriving = spark.readStream.schema(people(spark, sf_dir).schema).parquet(source)
    mask_stream.write_treated(arriving, result.treatments, "internal", SALT, KEY, book, out, _folder(spark, "stream-state"), hash_length=SHORT).start().awaitTermination()
    return spark.read.parquet(out).select(KEY, *COLUMNS)


@query
def anonymize_table_developer(spark, sf_dir):
    """Rows treated for testing: fakes keep the form, and equal values get equal fakes."""
    return _anonymized(spark, sf_dir, "developer").data
