"""The profile of a document out of its file name: ten fields, each with a value, a confidence and the evidence for it.

A field is read by rules in order; the first whose sign the name holds gives the value and how sure it is, and its sign is the evidence.
Without a sign the field has its default, less sure. Reviewed values take the place of what a name says.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs in file names and what they stand for.
ROLES = {"tasks": "TASK_SET", "ans": "ANSWER_KEY", "script": "LISTENING_SCRIPT", "criteria": "CRITERIA", "sol": "ANSWER_KEY"}
SUBJECTS = {
    "engl": "ENGLISH", "russ": "RUSSIAN", "math": "MATHEMATICS", "geog": "GEOGRAPHY", "biol": "BIOLOGY",
    "phys": "PHYSICS", "iikt": "INFORMATICS", "info": "INFORMATICS", "chem": "CHEMISTRY", "hist": "HISTORY",
}
STAGES = {"mun": "MUNICIPAL", "reg": "REGIONAL"}
TOURS = {"pism": "WRITTEN", "ustn": "ORAL", "teor": "WRITTEN"}
REGIONS = {
    "lenobl": "Ленинградская область", "kaluga": "Калужская область", "omsk": "Омская область", "novgorod": "Новгородская область",
    "kamchat": "Камчатский край", "kamchatka": "Камчатский край", "chel": "Челябинская область", "bash": "Республика Башкортостан",
    "irk": "Иркутская область", "tat": "Республика Татарстан", "sverd": "Свердловская область", "spb": "Санкт-Петербург",
    "vladimir": "Владимирская область", "kursk": "Курская область", "chuk": "Чукотский автономный округ", "kem": "Кемеровская область",
}
COMPETITION = "VSOSh"
# How sure a field is with a sign and without one.
SURE = {
    "role": (0.99, 0.99), "subject": (0.99, 0.45), "language": (0.78, 0.35), "academic_year": (0.98, 0.45), "grades": (0.98, 0.45),
    "competition": (0.72, 0.72), "stage": (0.97, 0.55), "tour": (0.94, 0.55), "region": (0.88, 0.52), "problemset": (0.91, 0.91),
}
REVIEWED = 0.995


@dataclass
class Sign:
    """A field's sign in the name: its pattern (or, listed, any of its meanings between dashes), what it stands for, and what holds without it."""

    label: str
    pattern: str
    meaning: dict[str, str] = field(default_factory=dict)
    default: str = "UNKNOWN"
    # what an unlisted sign means: nothing, or itself in capitals
    spelled: bool = False
    # of several signs in a name the first one listed counts, not the first in the name
    listed: bool = False


# The patterns of signs, and what is left off a name to get what its set shares.
_CODES = "|".join(SUBJECTS)
ENDING, PREFIX = r"\.[^.]+$", r"(?i)^(?:tasks?|ans(?:wers?)?|script|criteria|solutions?|audio)-"
SIGNS = {
    "role": Sign("filename prefix", f"^({'|'.join(ROLES)})-", ROLES, "OTHER"),
    "subject": Sign("filename subject token", f"-({_CODES})-", SUBJECTS, "OTHER"),
    "academic_year": Sign("filename academic-year token", r"-(\d{2}-\d{2})\.pdf$"),
    "grades": Sign("filename grade token", rf"-(?:{_CODES})-(\d+(?:-\d+)?)"),
    "stage": Sign("filename stage token", "", STAGES, listed=True),
    "tour": Sign("filename tour token", "", TOURS, listed=True),
    "region": Sign("filename region token", r"-(?:mun|reg)-([a-z0-9]+)-\d{2}-\d{2}\.pdf$", REGIONS, "UNKNOWN", True),
}


def stem(name: Column) -> Column:
    """What the files of one set share: the name in lower case without its ending and the prefix of its role."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, ENDING, ""), PREFIX, ""))


def _token(name: Column, sign: Sign) -> Column:
    """The field's sign in the name, or nothing."""
    if sign.listed:
        return F.coalesce(*[F.when(name.contains(f"-{t}-"), F.lit(t)) for t in sign.meaning], F.lit(""))
    return F.regexp_extract(name, sign.pattern, 1)


def _value(token: Column, key: str, sign: Sign) -> Column:
    if key == "academic_year":
        read = F.concat(F.lit("20"), F.replace(token, F.lit("-"), F.lit("/")))
    elif not sign.meaning:
        read = token
    else:
        pairs = [F.lit(x) for kv in sign.meaning.items() for x in kv]
        read = F.try_element_at(F.create_map(*pairs), token)
        if sign.spelled:
            read = F.coalesce(read, F.upper(token))
    return F.when(token == "", F.lit(sign.default)).otherwise(F.coalesce(read, F.lit(sign.default)))


def _made(value: Column, confidence: Column, snippet: Column, label: str, source: str) -> Column:
    evidence = F.struct(snippet.alias("snippet"), F.lit(label).alias("label"), F.lit(source).alias("source"))
    return F.struct(value.alias("value"), confidence.alias("confidence"), evidence.alias("evidence"))


def profile(name: Column, competition: str = COMPETITION) -> Column:
    """struct of the ten fields; each is struct(value, confidence, evidence: struct(snippet, label, source)). A null name counts as empty."""
    name = F.coalesce(name, F.lit(""))
    low = F.lower(name)
    out = {}
    for key, sign in SIGNS.items():
        token = _token(low, sign)
        value = _value(token, key, sign)
        known = value != sign.default
        snippet = F.when(token != "", F.concat(name, F.lit(' · token "'), token, F.lit('"'))).otherwise(name)
        out[key] = _made(value, F.when(known, SURE[key][0]).otherwise(SURE[key][1]), snippet, sign.label, "filename")
    foreign = _value(_token(low, SIGNS["subject"]), "subject", SIGNS["subject"]) == SUBJECTS["engl"]
    told = F.when(foreign, "Language requires document text").otherwise("Russian is the default language hypothesis for other subjects")
    out["language"] = _made(F.when(foreign, "UNKNOWN").otherwise("RU"), F.when(foreign, SURE["language"][1]).otherwise(SURE["language"][0]), told, "language heuristic", "heuristic")
    out["competition"] = _made(F.lit(competition), F.lit(SURE["competition"][0]), F.lit("A default of the corpus, not a claim of the text"), "corpus source default", "heuristic")
    out["problemset"] = _made(stem(name), F.lit(SURE["problemset"][0]), stem(name), "canonical filename stem", "derived")
    return F.struct(*[out[k].alias(k) for k in SURE])


def with_reviewed(rows: DataFrame, reviewed: DataFrame, key: str, column: str = "profile") -> DataFrame:
    """`rows` whose profile takes reviewed languages and roles (key, language, roles) for sure; an empty list of roles says nothing."""
    got = rows.join(reviewed.select(key, F.col("language").alias("_language"), F.try_element_at("roles", F.lit(1)).alias("_role")), key, "left")
    new = F.col(column)
    for name, by in (("language", F.col("_language")), ("role", F.col("_role"))):
        made = _made(by, F.lit(REVIEWED), F.concat(F.lit(f"Human-reviewed {name}: "), by), "calibration", "calibration")
        new = new.withField(name, F.when(F.coalesce(by, F.lit("")) != "", made).otherwise(F.col(f"{column}.{name}")))
    return got.withColumn(column, new).drop("_language", "_role")


def doubtful(column: Column, least: float = 0.6) -> Column:
    """Names of the fields whose confidence is below `least`, in their order."""
    return F.array_compact(F.array(*[F.when(column[k]["confidence"] < least, F.lit(k)) for k in SURE]))
