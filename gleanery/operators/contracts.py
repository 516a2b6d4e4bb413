"""Contracts of generated questions, repeated prompts, scripts and their segments; and what an explorer of a corpus shows.

Questions are rows (question, interaction, status, options: array of struct(id), answer: array of strings, tolerance, knowledge,
grade_min, grade_max). Nulls in a required field are violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The only status that a generator may put out, and interactions that have options.
DRAFT = "draft"
CHOICES = ("single_choice", "multi_choice", "sequence")
# Presence of a slot's tasks, from nothing known to the file itself.
UNKNOWN, LOCATED, RAW = "unknown", "located", "raw"
FETCHED = ("DOWNLOADED", "DUPLICATE")


def broken_drafts(questions: DataFrame, required: list[str]) -> DataFrame:
    """Rows (question, fault) of generated questions that break the contract, one for each rule broken."""
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.transform("options", lambda o: o["id"]), none)
    answer, kind = F.coalesce("answer", none), F.coalesce("interaction", F.lit(""))
    known = F.size(F.array_except(answer, ids)) == 0
    rules = [(F.col(c).isNull(), f"missing:{c}") for c in required]
    rules += [
        (F.coalesce("status", F.lit("")) != DRAFT, "published_directly"),
        (F.coalesce(F.size("knowledge"), F.lit(0)) <= 0, "no_knowledge"),
        (F.col("grade_min") > F.col("grade_max"), "grades_turned"),
        (kind.isin(*CHOICES) & (F.size(F.array_distinct(ids)) < F.size(ids)), "option_ids_repeat"),
        ((kind == "single_choice") & ~((F.size(answer) == 1) & known), "one_option_wanted"),
        ((kind == "multi_choice") & ~((F.size(answer) >= 2) & known), "several_options_wanted"),
        ((kind == "sequence") & ~((F.size(answer) == F.size(ids)) & (F.array_sort(answer) == F.array_sort(ids))), "every_option_once"),
        ((kind == "numeric") & F.col("options").isNotNull(), "options_of_a_number"),
        ((kind == "numeric") & (F.size(answer) == 0), "no_answer"),
        ((kind == "numeric") & ~F.coalesce(F.col("tolerance") == 0, F.lit(False)), "tolerance_not_exact"),
    ]
    faults = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]))
    return questions.select("question", F.explode(faults).alias("fault"))


def normal_prompt(text: Column) -> Column:
    """Lower case, signs and white space as one space."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Punct}]+", " ")))


def repeated_prompts(questions: DataFrame, prompt: str, units: str, key: str) -> DataFrame:
    """Rows (prompt_id, units, n, first) of prompts that come twice for the same units, in whatever order these are named. Prompts travel as digests."""
    same = F.md5(F.encode(normal_prompt(F.col(prompt)), "UTF-8"))
    rows = questions.where(normal_prompt(F.col(prompt)) != "").select(same.alias("prompt_id"), F.array_join(F.array_sort(F.array_distinct(units)), "|").alias("units"), F.col(key).alias("_key"))
    return rows.groupBy("prompt_id", "units").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first")).where("n > 1")


def other_scripts(scripts: DataFrame, segments: DataFrame, key: str, order: str, script: str = "script", text: str = "text") -> DataFrame:
    """Rows (key, fault) of scripts that their segments, joined by one space, do not make; scripts without segments too. White space counts as one space."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: plain(x["_t"]))
    made = segments.where(plain(F.col(text)) != "").groupBy(key).agg(F.array_join(pieces, " ").alias("_made"))
    both = scripts.select(key, plain(F.col(script)).alias("_script")).join(made, key, "left").where("_script <> ''")
    fault = F.when(F.col("_made").isNull(), "no_segments").when(F.col("_made") != F.col("_script"), "segments_differ")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def of_kind_and_unit(questions: DataFrame, kinds: list[str] | None = None, unit: str | None = None) -> DataFrame:
    """Questions of some kinds that assess a unit, by `interaction` and `knowledge`."""
    out = questions if kinds is None else questions.where(F.col("interaction").isin(*kinds))
    return out if unit is None else out.where(F.exists("knowledge", lambda k: k == unit))


def observed_presence(observations: DataFrame, assets: DataFrame) -> DataFrame:
    """`observations` (asset_id, role, fetch_status) with `presence`: the file is there, only its link is, or neither is known to be of tasks."""
    side = assets.select(F.col("asset_id").alias("_asset"), "has_raw_download").dropDuplicates(["_asset"])
    got = observations.join(side, F.col("asset_id") == F.col("_asset"), "left")
    raw = F.col("fetch_status").isin(*FETCHED) & F.col("has_raw_download")
    presence = F.when(~F.coalesce(F.col("role") == "tasks", F.lit(False)), UNKNOWN).when(F.coalesce(raw, F.lit(False)), RAW).otherwise(LOCATED)
    return got.withColumn("presence", presence).drop("_asset", "has_raw_download")


def explored(competitions: DataFrame, archives: DataFrame, observations: DataFrame, assets: DataFrame, subject: str | None = None, year: int | None = None, query: str = "") -> DataFrame:
    """Rows (tab, id) that pass the filters, as one explorer over four kinds of things.

    Competitions (id, name, subject_ids, season_from, season_to), archives (id, name, competition_ids), observations (id, name, subject, season) and
    assets (id, name, observation_ids). An archive has the subjects of its competitions and is found by their names too; an asset has what its
    observations have. Members are joined by id, not collected.
    """
    sought = query.strip().lower()
    named = F.lower(F.coalesce("name", F.lit(""))).contains(sought)
    by_subject = lambda c: F.lit(True) if subject is None else c
    by_year = lambda c: F.lit(True) if year is None else c
    of_subject = competitions.where(by_subject(F.array_contains("subject_ids", subject)))
    comps = of_subject.where(by_year(F.lit(year).between(F.col("season_from"), F.col("season_to")))).where(named)
    member = archives.select("id", "name", F.explode("competition_ids").alias("_c"))
    own = archives
    if subject is not None:
        own = own.join(member.join(of_subject.select(F.col("id").alias("_c")), "_c", "left_semi").select("id").distinct(), "id", "left_semi")
    if sought:
        related = member.join(competitions.where(named).select(F.col("id").alias("_c")), "_c", "left_semi").select("id").distinct().withColumn("_found", F.lit(True))
        own = own.join(related, "id", "left").where(named | F.col("_found").isNotNull())
    seen = observations.where(by_subject(F.col("subject") == subject)).where(by_year(F.col("season") == year))
    held = assets.where(named)
    for known, condition in ((subject, F.col("subject") == subject), (year, F.col("season") == year)):
        if known is not None:
            fits = assets.select("id", F.explode("observation_ids").alias("_o")).join(observations.where(condition).select(F.col("id").alias("_o")), "_o", "left_semi")
            held = held.join(fits.select("id").distinct(), "id", "left_semi")
    tab = lambda df, name: df.select(F.lit(name).alias("tab"), F.col("id").cast("string").alias("id"))
    return tab(comps, "competitions").unionByName(tab(own, "archives")).unionByName(tab(seen.where(named), "observations")).unionByName(tab(held, "assets"))


def saved_entries(entries: DataFrame, saved: DataFrame, key: str, lemma: str) -> DataFrame:
    """Entries that are saved, in the order of their lemmas without regard to case."""
    return entries.join(saved.select(key).distinct(), key, "left_semi").orderBy(F.lower(lemma), lemma, key)


# Rights under which content may be given on.
RIGHTS = ("owned_original", "licensed", "public_domain", "open_license")


def registry_faults(subjects: DataFrame, competitions: DataFrame) -> DataFrame:
    """Rows (id, fault) of a registry's subjects (id) and competitions (id, subject_ids, season_from, season_to, stages, links, source_ids) that break its rules."""
    told = lambda df, fault: df.select(F.col("id").cast("string").alias("id"), F.lit(fault).alias("fault"))
    out = told(subjects.groupBy("id").count().where("count > 1"), "subject_repeats").unionByName(told(competitions.groupBy("id").count().where("count > 1"), "competition_repeats"))
    named = competitions.select("id", F.explode("subject_ids").alias("_s"))
    out = out.unionByName(told(named.join(subjects.select(F.col("id").alias("_s")), "_s", "left_anti").select("id").distinct(), "unknown_subject"))
    stages, links = F.coalesce("stages", F.array().cast("array<string>")), F.coalesce("links", F.array().cast("array<string>"))
    rules = [
        (~F.coalesce(F.col("season_from") <= F.col("season_to"), F.lit(False)), "seasons_turned"),
        ((F.size(stages) == 0) | (F.size(F.array_distinct(stages)) < F.size(stages)), "stages_missing_or_repeated"),
        (F.exists(links, lambda x: ~F.coalesce(F.lower(x).startswith("https://"), F.lit(False))), "link_without_https"),
        (F.exists(F.coalesce("source_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) == ""), "empty_source"),
    ]
    faults = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))
    return out.unionByName(competitions.select(F.col("id").cast("string").alias("id"), F.explode(faults).alias("fault")))


def licence_faults(licences: DataFrame) -> DataFrame:
    """Rows (licence_id, fault) of licences (licence_id, rights_type, active, distribution_allowed, territories) under which nothing may be given on."""
    rules = [
        (~F.coalesce(F.col("rights_type").isin(*RIGHTS), F.lit(False)), "unverified_rights"),
        (~F.coalesce(F.col("active") & F.col("distribution_allowed"), F.lit(False)), "inactive_or_undistributable"),
        (F.coalesce(F.size("territories"), F.lit(0)) <= 0, "no_territories"),
    ]
    return licences.select("licence_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))).alias("fault"))


def pack_faults(packs: DataFrame, grants: DataFrame, licences: DataFrame, targets: DataFrame, blueprint: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (pack_id, fault, detail) of enabled packs that lack what they need: a grant, a good licence, a target, a blueprint whose units are known, named once and asked for.

    Packs (pack_id, enabled, licence_id), grants (pack_ids, active), targets (pack_id), blueprint rows (pack_id, unit, weight), questions (pack_id, knowledge),
    units (unit).
    """
    open_ = packs.where(F.coalesce("enabled", F.lit(False))).select("pack_id", "licence_id")
    told = lambda df, fault, detail: df.select("pack_id", F.lit(fault).alias("fault"), detail.cast("string").alias("detail"))
    none = F.lit("")
    granted = grants.where(F.coalesce("active", F.lit(False))).select(F.explode("pack_ids").alias("pack_id"))
    bad = licence_faults(licences).select("licence_id").distinct()
    good = licences.select("licence_id").join(bad, "licence_id", "left_anti")
    out = told(open_.join(granted, "pack_id", "left_anti"), "no_grant", none)
    out = out.unionByName(told(open_.join(good, "licence_id", "left_anti"), "no_licence", F.coalesce(F.col("licence_id").cast("string"), none)))
    out = out.unionByName(told(open_.join(targets.select("pack_id"), "pack_id", "left_anti"), "no_target", none))
    out = out.unionByName(told(open_.join(blueprint.select("pack_id"), "pack_id", "left_anti"), "no_blueprint", none))
    own = blueprint.join(open_.select("pack_id"), "pack_id", "left_semi")
    out = out.unionByName(told(own.groupBy("pack_id", "unit").count().where("count > 1"), "unit_repeats", F.col("unit")))
    out = out.unionByName(told(own.select("pack_id", "unit").distinct().join(units.select("unit"), "unit", "left_anti"), "unknown_unit", F.col("unit")))
    asked = questions.select("pack_id", F.explode("knowledge").alias("unit")).distinct()
    out = out.unionByName(told(own.select("pack_id", "unit").distinct().join(asked, ["pack_id", "unit"], "left_anti"), "unit_not_asked_for", F.col("unit")))
    return out.unionByName(told(own.where(~F.coalesce(F.col("weight") > 0, F.lit(False))), "weight_not_positive", F.col("unit")))
