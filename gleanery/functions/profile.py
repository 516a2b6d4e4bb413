"""The rule profile for task sheets: markers, section types, kinds of tasks, roles of lines. Column expressions over fixed patterns.

Patterns hold in Python's, Java's and DuckDB's dialects, without flags: `found` adds case-blindness and Unicode classes, and, with `across`, a
dot that matches line ends.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of tasks, parts, sub-parts, items, ranges and sets.
TASK = r"^\s*(?:task|problem|question|exercise|задача|задание|вопрос)\b\s*(?:№\s*)?([0-9]{1,3}|[A-ZА-Я])\b[\s.):-]*(.*)$"
TASK_INSIDE = r"(?:^|\s)(?:task|problem|question|exercise|задача|задание|вопрос)\b\s*(?:№\s*)?([0-9]{1,3}|[A-ZА-Я])\b"
PART = r"^\s*(?:part|часть)\b\s*(?:№\s*)?([0-9]{1,3}|[A-ZА-Я])\b[\s.):-]*(.*)$"
SUBPART = r"^\s*(?:\(([a-zа-я])\)|([a-zа-я])[.)]|\((i{1,3}|iv|v|vi{0,3}|ix|x)\))\s+\S"
DECIMAL_TASK = r"^\s*([0-9]{1,3}\.[0-9]{1,3})\.?(?:\s+|$)"
GROUP_SECTION = r"^\s*(?:часть|раздел|part|section)\s+([0-9IVX]+)\s*[.:]?\s*$"
ANSWER_TO = r"(?:ответ\s+на\s+вопрос|answer\s+to\s+question)\s*(?:№\s*)?([0-9]{1,3}(?:\.[0-9]{1,3})?)"
ITEM = r"^\s*([0-9]{1,3})(?:[.)])?\s+\S"
RANGE = r"\b(?:questions?|items?|gaps?|sentences?)\s*(?:№\s*)?([0-9]{1,3})\s*[-–—]\s*([0-9]{1,3})\b"
SET = r"^\s*(?:speaking\s+)?set\s*([0-9]{1,3}|[A-Z])\b"

# Types of sections, the first that matches wins.
SECTIONS = [
    ("LISTENING", r"^\s*listening\b"),
    ("READING", r"^\s*reading\b"),
    ("USE_OF_ENGLISH", r"^\s*use\s+of\s+english\b"),
    ("SPEAKING_SET", r"^\s*(?:speaking\s+)?set\s*[0-9A-Z]+\b"),
    ("SPEAKING", r"^\s*speaking\b"),
    ("TRANSCRIPTION", r"^\s*(?:transcription|transcript|tapescript)\b"),
    ("CRITERIA", r"^\s*(?:criteria\b|критерии\b)"),
    ("METHODOLOGY", r"^\s*методическ(?:ие|ая)\s+(?:рекомендации|рекомендация)\b"),
    ("WRITING", r"^\s*writing\b"),
    ("ANSWERS", r"^\s*(?:(?:listening|reading|use\s+of\s+english)\s+)?answers?\s*$"),
]
# A heading of writing criteria, prose about scores inside one, and the head of a scheme.
RUBRIC, SCORES, SCHEME = r"критери|criteria|rubric", r"максимальн|maximum|оценива|evaluat|\bбалл|\bpoints?\b", r"схем[аы]\s+подсчет|scheme|rubric"
SKILLS = ("LISTENING", "READING", "USE_OF_ENGLISH", "WRITING")

# Kinds of tasks, the first that matches wins; patterns whose dots match line ends are marked so.
KINDS = [
    ("SELECT_MULTIPLE", True, r"choose\s+(?:all|two|three|several|multiple).*?(?:correct|true)|select\s+(?:all|two|three|several|multiple).*?(?:correct|true)|выберите\s+(?:все|несколько).*?(?:правильн|верн)|укажите\s+все\s+верн"),
    ("TRUE_FALSE_NOT_STATED", True, r"true\s*\([^)]*\).*false\s*\([^)]*\).*not\s+stated|true.*false.*not\s+stated"),
    ("TRUE_FALSE", True, r"\btrue\b.*\bfalse\b"),
    ("FORM_FILL", False, r"complete\s+the\s+form|fill\s+in\s+the\s+form"),
    ("TABLE_GAP_FILL", False, r"complete\s+the\s+table|fill\s+in\s+the\s+table|заполните\s+таблиц"),
    ("KEY_WORD_TRANSFORMATION", True, r"key\s+word|complete.*second\s+sentence.*meaning|second\s+sentence.*similar\s+meaning"),
    ("WORD_FORMATION", False, r"word\s+formation|form\s+(?:a|the)\s+word|use\s+the\s+word\s+given|word\s+given\s+in\s+capitals"),
    ("IDIOM", False, r"\bidioms?\b"),
    ("MATCHING", False, r"\bmatch\b|choose\s+the\s+correct\s+paragraph|which\s+paragraph|choose\s+from\s+the\s+paragraphs|установите\s+соответств|соотнесите"),
    ("ORDERING", True, r"put.*(?:correct|right)\s+order|arrange.*order|расположите.*порядк|установите\s+последовательност"),
    ("MULTIPLE_CHOICE_CLOZE", True, r"(?:which|decide\s+which)\s+answer.*(?:fits?|best\s+fits?)\s+each\s+gap|decide\s+which\s+answer.*best\s+fits.*gap"),
    ("OPEN_CLOZE", False, r"think\s+of\s+the\s+word\s+which\s+best\s+fits\s+each\s+gap|(?:one|two)\s+word(?:s)?\s+for\s+each\s+(?:answer|gap)|one\s+word\s+per\s+gap"),
    ("SELECT_ONE", True, r"choose\s+the\s+correct\s+answer|choose\s+(?:a|one)\s+(?:correct\s+)?(?:option|answer)|choose\s+[A-DА-Д](?:\s*,\s*[A-DА-Д]){1,3}.*(?:answer|question)|choose\s+the\s+answer\s*\([A-DА-Д]|выберите\s+(?:один\s+)?правильн(?:ый|ого)\s+(?:вариант|ответ)|укажите\s+один\s+верн"),
    ("OPEN_SHORT", False, r"answer\s+the\s+following\s+questions|give\s+(?:a\s+)?short\s+answer|ответьте\s+на\s+вопрос|дайте\s+кратк"),
    ("GAP_FILL", False, r"complete\s+(?:the\s+)?(?:sentences?|text)|fill\s+(?:in\s+)?(?:the\s+)?gaps?|missing\s+information"),
    ("EXTENDED_RESPONSE", False, r"write\s+(?:your\s+)?(?:essay|article|letter|report|story|review)|write\s+[0-9]+\s*[-–]\s*[0-9]+\s+words|\([0-9]+\s*[-–]\s*[0-9]+\s+words\)"),
    ("PROOF", False, r"\bprove\b|докаж"),
    ("PROGRAMMING", False, r"write\s+(?:a\s+)?program|\balgorithm\b|напишите\s+программ|программ|алгоритм"),
    ("ORAL_RESPONSE", False, r"\bmonologue\b|\bdialogue\b|\bspeak\b|talk\s+about|устн|монолог|диалог"),
    ("NUMERIC_RESPONSE", False, r"\bcalculate\b|\bcompute\b|\bfind\s+(?:the\s+)?(?:value|number)|вычисл|найдите\s+(?:значение|число)"),
]
# Of each kind, words one of which every match of its pattern holds in a cleaned text in lower case. Finding them costs far less than a pattern.
WORDS = {
    "SELECT_MULTIPLE": ("choose ", "select ", "выберите ", "укажите "),
    "TRUE_FALSE_NOT_STATED": ("not stated",),
    "TRUE_FALSE": ("false",),
    "FORM_FILL": ("the form",),
    "TABLE_GAP_FILL": ("the table", "заполните таблиц"),
    "KEY_WORD_TRANSFORMATION": ("key word", "second sentence"),
    "WORD_FORMATION": ("word formation", "form a word", "form the word", "the word given", "word given in"),
    "IDIOM": ("idiom",),
    "MATCHING": ("match", "correct paragraph", "which paragraph", "the paragraphs", "установите соответств", "соотнесите"),
    "ORDERING": ("correct order", "right order", "arrange", "расположите", "установите последовательност"),
    "MULTIPLE_CHOICE_CLOZE": ("which answer",),
    "OPEN_CLOZE": ("think of the word", "for each", "word per gap"),
    "SELECT_ONE": ("choose ", "выберите ", "укажите один"),
    "OPEN_SHORT": ("the following questions", "short answer", "ответьте на", "дайте кратк"),
    "GAP_FILL": ("complete ", "fill ", "missing information"),
    "EXTENDED_RESPONSE": ("write ", " words)"),
    "PROOF": ("prove", "докаж"),
    "PROGRAMMING": ("program", "algorithm", "программ", "алгоритм"),
    "ORAL_RESPONSE": ("monologue", "dialogue", "speak", "talk about", "устн", "монолог", "диалог"),
    "NUMERIC_RESPONSE": ("calculate", "compute", "find ", "вычисл", "найдите "),
}
# Signs that match other letters where case is not told apart, but that lower case does not make those letters.
ODD = "\u0130\u0131\u017f\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86"
# The patterns of KINDS whose dots match line ends, as pieces that come one after the other. Written as one pattern, each
# piece is sought again from every place of those before it, which takes the square or the cube of the text.
ORDERED = {
    "SELECT_MULTIPLE": [(r"(?:choose|select)\s+(?:all|two|three|several|multiple)", "correct|true"), (r"выберите\s+(?:все|несколько)", "правильн|верн"), (r"укажите\s+все\s+верн",)],
    "TRUE_FALSE_NOT_STATED": [("true", "false", r"not\s+stated")],
    "TRUE_FALSE": [(r"\btrue\b", r"\bfalse\b")],
    "KEY_WORD_TRANSFORMATION": [(r"key\s+word",), ("complete", r"second\s+sentence", "meaning"), (r"second\s+sentence", r"similar\s+meaning")],
    "ORDERING": [("put", r"(?:correct|right)\s+order"), ("arrange", "order"), ("расположите", "порядк"), (r"установите\s+последовательност",)],
    "MULTIPLE_CHOICE_CLOZE": [(r"which\s+answer", r"fits?\s+each\s+gap"), (r"decide\s+which\s+answer", r"best\s+fits", "gap")],
    "SELECT_ONE": [
        (r"choose\s+the\s+correct\s+answer|choose\s+(?:a|one)\s+(?:correct\s+)?(?:option|answer)|choose\s+the\s+answer\s*\([A-DА-Д]|выберите\s+(?:один\s+)?правильн(?:ый|ого)\s+(?:вариант|ответ)|укажите\s+один\s+верн",),
        (r"choose\s+[A-DА-Д]\s*,\s*[A-DА-Д]", "answer|question"),
    ],
}

# How kinds are answered, and the kinds whose options are no parts.
MODES = {
    "SELECT": ("SELECT_ONE", "SELECT_MULTIPLE", "TRUE_FALSE", "TRUE_FALSE_NOT_STATED", "MATCHING", "ORDERING", "MULTIPLE_CHOICE_CLOZE"),
    "TEXT_SHORT": ("GAP_FILL", "TABLE_GAP_FILL", "FORM_FILL", "OPEN_CLOZE", "OPEN_SHORT", "KEY_WORD_TRANSFORMATION", "WORD_FORMATION", "IDIOM"),
    "TEXT_LONG": ("EXTENDED_RESPONSE", "PROOF", "DERIVATION"),
    "NUMBER": ("NUMERIC_RESPONSE",),
    "CODE": ("PROGRAMMING",),
    "SPEECH": ("ORAL_RESPONSE",),
    "MIXED": ("COMPOSITE",),
}
WITH_OPTIONS = ("SELECT_ONE", "SELECT_MULTIPLE", "MULTIPLE_CHOICE_CLOZE", "MATCHING")

# Signs of a line's role.
OPTION = r"^\s*(?:[A-HА-З][.)]|\([A-HА-З]\)|[0-9]{1,2}[.)])\s+\S"
CAPTION = r"^\s*(?:рис\.?|рисунок|figure|fig\.?|table|таблица|map|карта|graph|chart|график|diagram|схема)\b"
INSTRUCTION = r"\b(?:choose|select|match|complete|fill|answer|write|read|listen|calculate|compute|find|prove|determine|identify|arrange|compare|explain|выберите|укажите|соотнесите|установите|заполните|ответьте|напишите|прочитайте|вычислите|найдите|докажите|расположите|определите|рассмотрите)\b"
DEPENDENCY = r"\b(?:previous|preceding|above|earlier|using\s+your\s+answer|предыдущ|выше|полученн|используя\s+ответ)\b"
FORMULA = r"[=<>±×÷√∑∫∞≈≠≤≥]|(?:\b[a-zA-Z]\s*[²³^]|\d+\s*/\s*\d+)"
CODE = r"\b(?:for|while|if|else|return|def|class|print|input|int|float|bool|var|let|const)\b|[{};]"
# Labels of writing tasks, by the words that name them.
WRITING_WORDS = [("articles", "Article"), ("article", "Article"), ("essay", "Essay"), ("letter", "Letter"), ("report", "Report"), ("review", "Review"), ("story", "Story")]
WRITE = r"write\s+(?:your\s+|an?\s+|the\s+)?(article|essay|letter|report|review|story)\b"
# Names of files by the document's role.
FILE_ROLES = [("LISTENING_SCRIPT", r"^(?:script|transcript|tapescript)-"), ("ANSWER_KEY", r"^(?:ans|answer|answers|solutions)-"), ("CRITERIA", r"^criteria-"), ("TASK_SET", r"^(?:tasks|task)-")]
# Words near an artifact that name it.
MAP_WORDS, GRAPH_WORDS, FIGURE_WORDS, BANK_WORDS = r"\b(?:map|карта|картосхем|контурн)", r"\b(?:graph|chart|plot|график|климатограмм)", r"\b(?:figure|fig\.?|рисунок|рис\.)", r"word\s*bank|слова\s+для\s+справ"


def _flags(pattern: str, across: bool, case: bool = False) -> str:
    return f"(?{'' if case else 'iu'}{'s' if across else ''}U){pattern}"


def found(text: Column, pattern: str, across: bool = False) -> Column:
    return text.rlike(_flags(pattern, across))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group `n` of the first match; empty without one."""
    return F.regexp_extract(text, _flags(pattern, False), n)


def cascade(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def instruction(text: Column) -> Column:
    """Hyphenated line ends joined, white space as one space."""
    text = F.coalesce(text, F.lit(""))
    joined = F.regexp_replace(text, r"([A-Za-zА-Яа-яЁё])-\s*\n\s*([A-Za-zА-Яа-яЁё])", "$1$2")
    # single spaces stay as they are
    return F.trim(F.regexp_replace(F.when(F.contains(text, F.lit("-")), joined).otherwise(text), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def _in_order(text: Column, pieces: tuple[str, ...]) -> Column:
    """Whether the pieces come one after the other. Each is taken where it first ends and never looked for again, so that the time is that of one pass."""
    return found(text, r"\A" + "".join(f"(?>.*?(?:{p}))" for p in pieces), True)


def kind(text: Column, has_parts: Column | None = None) -> Column:
    # the cleaned text, and what is sought in it, are fields of an array's element, so that they are computed once and not for each rule
    odd = lambda t: reduce(or_, (F.contains(t, F.lit(c)) for c in ODD))
    cleaned = F.transform(F.array(instruction(text)), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), odd(t).alias("odd")))

    def holds(x: Column, kind: str, across: bool, pattern: str) -> Column:
        may = reduce(or_, (F.contains(x["low"], F.lit(w)) for w in WORDS[kind]), x["odd"])
        return may & (reduce(or_, (_in_order(x["t"], p) for p in ORDERED[kind])) if across else found(x["t"], pattern))

    known = F.transform(cleaned, lambda x: cascade([(holds(x, k, across, p), k) for k, across, p in KINDS], "UNKNOWN"))[0]
    return known if has_parts is None else F.when(has_parts, "COMPOSITE").otherwise(known)


def mode(kind: Column) -> Column:
    return cascade([(kind.isin(*ks), m) for m, ks in MODES.items()], "UNKNOWN")


def section_type(text: Column) -> Column:
    """The type of section that a heading opens; null for other lines. Writing criteria are criteria, unless the line is prose about scores."""
    t = F.trim(text)
    rubric = found(t, r"^writing\b") & found(t, RUBRIC)
    return cascade([(found(t, GROUP_SECTION), "PART_GROUP"), (rubric & found(t, SCORES), "WRITING"), (rubric, "CRITERIA"), *((found(t, p), k) for k, p in SECTIONS)])


def heading_score(text: Column, size: Column, median: Column, bold: Column) -> Column:
    """How much a line looks like a heading, from 0 to 1."""
    t = F.trim(text)
    upper, letters = F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}"))
    looks = F.when(upper >= 0.8 * F.greatest(letters, F.lit(1)), 0.35).otherwise(0.0) + F.when((median > 0) & (size >= 1.18 * median), 0.25).otherwise(0.0)
    looks = looks + F.when(bold, 0.15).otherwise(0.0) + F.when(F.length(t) <= 40, 0.1).otherwise(0.0)
    return F.when((t == "") | (F.length(t) > 90), 0.0).when(section_type(t).isNotNull(), 1.0).otherwise(F.round(looks, 2))


def line_role(text: Column, marker: Column, y0: Column, page_height: Column, fonts: Column) -> Column:
    """struct(role, confidence, reason) of a line of a task."""
    t = F.trim(text)
    hits = F.regexp_count(t, F.lit(_flags(FORMULA, False, case=True)))
    mono = F.lower(F.concat_ws(" ", fonts)).rlike("courier|mono")
    rules = [
        (marker, "TASK_MARKER", 0.99, "explicit_task_marker"),
        ((page_height > 0) & (y0 >= 0.94 * page_height), "FOOTNOTE", 0.72, "bottom_margin"),
        (found(t, CAPTION), "CAPTION", 0.92, "caption_prefix"),
        (found(t, OPTION), "OPTION_LIST", 0.9, "option_marker"),
        (mono & found(t, CODE), "CODE_BLOCK", 0.88, "monospace_code_signal"),
        ((hits >= 2) | ((hits >= 1) & (F.length(t) <= 90)), "FORMULA_TEXT", 0.84, "formula_symbols"),
        (found(t, INSTRUCTION), "INSTRUCTION", 0.88, "instruction_verb"),
        (F.length(t) <= 2, "UNKNOWN", 0.45, "too_short"),
    ]
    made = lambda r, c, why: F.struct(F.lit(r).alias("role"), F.lit(c).alias("confidence"), F.lit(why).alias("reason"))
    out = made("BODY_TEXT", 0.8, "default_body")
    for condition, *rest in reversed(rules):
        out = F.when(condition, made(*rest)).otherwise(out)
    return out


def writing_label(text: Column) -> Column:
    direct = group(text, WRITE)
    return F.when(direct != "", F.initcap(F.lower(direct))).otherwise(cascade([(found(text, rf"\b{w}\b"), label) for w, label in WRITING_WORDS], "Writing task"))


def is_task(text: Column) -> Column:
    return found(text, TASK) | found(text, DECIMAL_TASK)


def task_number(text: Column) -> Column:
    return F.when(found(text, TASK), group(text, TASK)).otherwise(group(text, DECIMAL_TASK))


def task_label(text: Column) -> Column:
    return F.when(is_task(text), F.concat(F.lit("Task "), task_number(text))).otherwise(F.substring(text, 1, 80))


def section_label(text: Column, section: Column) -> Column:
    t = F.trim(text)
    return F.when((section == "UNKNOWN") & is_task(t), "Tasks").when((section == "SPEAKING_SET") & found(t, SET), F.concat(F.lit("Speaking Set "), group(t, SET))).otherwise(F.substring(t, 1, 100))


def document_role(name: Column, explicit: Column) -> Column:
    """The explicit role, else that of the file name's prefix, else empty."""
    last = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1))
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).otherwise(cascade([(found(last, p), r) for r, p in FILE_ROLES], ""))


def bundle_key(name: Column) -> Column:
    """What the files of one set share: the name without role and ending, other signs as dashes."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    stem = F.regexp_replace(stem, r"^(?:tasks?|ans(?:wers?)?|criteria|script|solutions?|audio)[-_]", "")
    return F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9а-яё]+", "-"), "^-+|-+$", "")


def artifact_kind(raw: Column, task_kind: Column, nearby: Column, cells: Column) -> Column:
    """struct(kind, confidence, reason) of a table, image or group of drawings, by its task and the text near it."""
    rules = [
        ((raw == "table") & task_kind.isin("TRUE_FALSE", "TRUE_FALSE_NOT_STATED", "TABLE_GAP_FILL"), "RESPONSE_TABLE", 0.94, "task_kind_table"),
        ((raw == "table") & (task_kind == "FORM_FILL"), "FORM", 0.92, "form_fill_table"),
        ((raw == "table") & found(nearby, BANK_WORDS), "WORD_BANK", 0.9, "nearby_word_bank_caption"),
        ((raw == "table") & (cells >= 16), "GRID", 0.82, "dense_cell_grid"),
        (raw == "table", "TABLE", 0.91, "pdf_table"),
        (found(nearby, MAP_WORDS), "MAP", 0.88, "nearby_map_caption"),
        (found(nearby, GRAPH_WORDS), "GRAPH", 0.88, "nearby_graph_caption"),
        (found(nearby, FIGURE_WORDS), "FIGURE", 0.87, "nearby_figure_caption"),
        (raw == "image", "FIGURE", 0.78, "generic_image"),
    ]
    made = lambda k, c, why: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(why).alias("reason"))
    out = made("DIAGRAM", 0.72, "vector_drawing_group")
    for condition, *rest in reversed(rules):
        out = F.when(condition, made(*rest)).otherwise(out)
    return out
