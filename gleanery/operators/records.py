"""Crawl decisions, joins of registries, order rules, sessions and checks on records."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators.folds import fold

# Endings of documents that are kept, and those of media types.
ENDINGS = [".pdf", ".zip", ".doc", ".docx", ".mp3", ".wav", ".m4a", ".jpg", ".jpeg", ".png"]
BY_TYPE = {
    "application/pdf": ".pdf", "application/zip": ".zip", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "audio/mpeg": ".mp3", "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/mp4": ".m4a", "image/jpeg": ".jpg", "image/png": ".png",
}


#: Endings of other media types, as Python's own table has them.
_TYPES = mimetypes.MimeTypes(filenames=())
GENERAL = {t: e for t in sorted(_TYPES.types_map[True].values()) if (e := _TYPES.guess_extension(t))}


def extension(url: Column, mime: Column) -> Column:
    """The file ending by the URL's path, else by the media type (the fixed table first, then the general one), else `.bin`."""
    own = F.lower(F.regexp_extract(urls.path(url), r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in (GENERAL | BY_TYPE).items() for x in kv])
    return F.when(own.isin(ENDINGS), own).otherwise(F.coalesce(F.try_element_at(table, F.trim(F.lower(F.split(mime, ";")[0]))), F.lit(".bin")))


# How documents of two kinds begin, endings that no web page has, and the reasons why bytes are no document.
MAGIC = {".pdf": [b"%PDF-"], ".zip": [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"]}
NO_PAGES = (".pdf", ".doc", ".docx", ".zip")
EMPTY, LARGE, NOT_PDF, NOT_ZIP, PAGE = "empty_body", "file_too_large", "invalid_pdf_magic", "invalid_zip_magic", "html_instead_of_document"


def invalid(data: Column, ending: Column, mime: Column, most: int) -> Column:
    """Why fetched bytes are no such document; null if they may be one."""

    def other(kind: str) -> Column:
        begins = F.lit(False)
        for sign in MAGIC[kind]:
            begins = begins | (F.substring(data, 1, len(sign)) == F.lit(sign))
        return (ending == kind) & ~begins

    page = F.lower(F.coalesce(mime, F.lit(""))).contains("text/html") & ending.isin(*NO_PAGES)
    size = F.octet_length(data)
    return F.when(data.isNull() | (size == 0), EMPTY).when(size > most, LARGE).when(other(".pdf"), NOT_PDF).when(other(".zip"), NOT_ZIP).when(page, PAGE)


def allowed(url: Column, include: Column, exclude: Column) -> Column:
    """Whether a URL passes a row's own patterns, where it has any; case does not count."""
    some = lambda p: F.coalesce(p, F.lit("")) != ""
    hit = lambda p: F.coalesce(F.regexp_like(url, F.concat(F.lit("(?iu)"), p)), F.lit(False))
    return (~some(include) | hit(include)) & ~(some(exclude) & hit(exclude))


def in_scope(url: Column, root: Column, pattern: Column | None = None) -> Column:
    """Whether a page is to be crawled: no document, on the root's host, and by the pattern or else below the root's path."""
    below = urls.path(url).startswith(F.regexp_replace(urls.path(root), "/+$", ""))
    rule = below if pattern is None else F.when(F.coalesce(pattern, F.lit("")) != "", F.regexp_like(url, F.concat(F.lit("(?iu)"), pattern))).otherwise(below)
    return ~urls.likely_file(url) & (urls.host(url) == urls.host(root)) & rule


def last_known(rows: DataFrame, facts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """`rows` with the last known `value` of their key; null where none is."""
    last = facts.groupBy(key).agg(F.max_by(value, order).alias(value))
    return rows.join(last, key, "left")


def with_policy(rows: DataFrame, policy: DataFrame, by: str) -> DataFrame:
    """`rows` with `allowed`: what the policy says of their site; unknown sites are denied."""
    return rows.join(policy.select(by, "allowed"), by, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def of_first(rows: DataFrame, members: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """`rows` with the value of the first registry row whose array `keys` holds their key."""
    flat = members.select(F.explode("keys").alias(key), value, order)
    return rows.join(flat.groupBy(key).agg(F.min_by(value, order).alias(value)), key, "left")


def page_of(rows: DataFrame, sections: DataFrame, by: list[str], page: str, first: str, last: str, name: str) -> DataFrame:
    """`rows` with the first of the sections (by, first, last, name) that hold their page. Sections of a key are exploded to pages: an equi-join."""
    pages = sections.select(*by, F.explode(F.sequence(first, last)).alias(page), F.struct(F.col(first), F.col(name)).alias("_s"))
    held = pages.groupBy(*by, page).agg(F.min("_s").alias("_s"))
    return rows.join(held, [*by, page], "left").withColumn(name, F.col(f"_s.{name}")).drop("_s")


# Fixed value: a Latin word.
WORD = r"[A-Za-z][A-Za-z'’-]*"


def normal_word(word: Column) -> Column:
    """A dictionary's form of a word: lower case, without signs at its ends and without 's."""
    trimmed = F.regexp_replace(F.lower(word), "^[^a-z]+|[^a-z]+$", "")
    return F.regexp_replace(trimmed, "['’]s$", "")


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A row (key, nth, start, token) for each Latin word; `start` counts characters from 0."""
    gap = F.split(text, WORD, -1)
    each = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("token"), gap.alias("gap"))
    flat = rows.select(key, F.posexplode(each).alias("nth", "x")).where("x.token is not null").select(key, "nth", "x.token", F.length("x.gap").alias("_g"))
    before = W.partitionBy(key).orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    return flat.withColumn("start", F.sum(F.col("_g") + F.length("token")).over(before) - F.length("token")).drop("_g")


def word_sums(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, tokens, starts, last, forms) of `tokens` in sum: how many words, the sum of their starts, the greatest word, how many forms. Keys without words have no row.

    A text's words stay in its row; of them only its distinct forms are grouped. Rows of one key count each from its own start.
    """
    split = rows.select(F.col(key).alias("k"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"), F.split(text, WORD, -1).alias("gap"))
    n = F.size("w").cast("long")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    # a gap stands before its word and all after it, a word before those after it
    starts = total(F.transform("gap", lambda g, i: F.length(g) * (n - i))) + total(F.transform("w", lambda w, i: F.length(w) * (n - i - 1)))
    # a word of letters only is its form in lower case
    form = lambda w: F.when(F.contains(w, F.lit("'")) | F.contains(w, F.lit("’")) | F.contains(w, F.lit("-")), normal_word(w)).otherwise(F.lower(w))
    forms = F.array_distinct(F.transform(F.array_distinct("w"), form))
    each = split.select("k", n.alias("tokens"), starts.alias("starts"), F.array_max("w").alias("last"), forms.alias("forms"))
    got = each.groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("starts").alias("starts"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("forms")))).cast("long").alias("forms"))
    return got.where("tokens > 0").withColumnRenamed("k", key)


def cyrillic_only(text: Column) -> Column:
    """Cyrillic stands in the text, and no Latin word of three letters or more."""
    return text.rlike("[А-Яа-яЁё]") & ~text.rlike("[A-Za-z]{3,}")


def derived(text: Column, rule: Column) -> Column:
    """The answer that follows from the whole numbers of a text by the rule's name: sum, product, difference, largest."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("long"))
    fold = lambda start, f: F.aggregate(numbers, F.lit(start).cast("long"), f)
    return F.when(rule == "sum", fold(0, lambda a, x: a + x)).when(rule == "product", fold(1, lambda a, x: a * x)).when(rule == "difference", F.try_element_at(numbers, F.lit(1)) - F.try_element_at(numbers, F.lit(2))).when(rule == "largest", F.array_max(numbers))


def days_left(until: Column, today: Column) -> Column:
    """Whole days from today; -1 where the date is unset, bad or past."""
    return F.coalesce(F.greatest(F.datediff(F.to_date(until), F.to_date(today)), F.lit(-1)), F.lit(-1))


def escaped(text: Column) -> Column:
    """The five signs of markup as references."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def csv_field(text: Column) -> Column:
    """A field of a CSV line, quoted where it has to be."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def next_states(rows: DataFrame, version: str, most: int = 4) -> DataFrame:
    """Parse states (sha, status, attempts, version, good) after one more run: terminal rows of the same version stay; a fourth failure is terminal."""
    done = F.col("status").isin("PARSED", "FAILED_TERMINAL") & (F.col("version") == version)
    tries = F.col("attempts") + 1
    after = F.when(F.col("good"), "PARSED").when(tries >= most, "FAILED_TERMINAL").otherwise("FAILED_RETRYABLE")
    return rows.withColumns({"skipped": done, "status": F.when(done, F.col("status")).otherwise(after), "attempts": F.when(done, F.col("attempts")).otherwise(tries), "version": F.lit(version)})


def unacknowledged(events: DataFrame, acknowledged: DataFrame, key: str) -> DataFrame:
    """Events that are still to be sent."""
    return events.join(acknowledged.select(key).distinct(), key, "left_anti")


def not_recent(pool: DataFrame, recent: DataFrame, by: str, key: str, order: list[Column], want: int) -> DataFrame:
    """`want` rows of each `by`: those not seen recently first, then, where they are short, seen ones, the longest ago first.

    `recent`: rows (by, key, seen), the larger the later.
    """
    rows = pool.join(recent.select(by, key, "seen"), [by, key], "left")
    turn = F.row_number().over(W.partitionBy(by).orderBy(F.col("seen").isNotNull(), "seen", *order))
    return rows.withColumn("slot", turn).where(F.col("slot") <= want)


def balanced(rows: DataFrame, by: str, kind: str, order: list[Column], each: int = 3) -> DataFrame:
    """`each` rows of every kind, dealt in turns so that kinds alternate."""
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(by, kind).orderBy(*order))).where(F.col("_n") <= each)
    return rows.withColumn("slot", F.row_number().over(W.partitionBy(by).orderBy("_n", kind))).drop("_n")


def reinforced(rows: DataFrame, by: str, unit: str, order: str, missed: Column) -> DataFrame:
    """Rows (by, unit, missed_at, again_at): a missed unit's first miss, and the place 3 to 5 later at which it comes again (by hash)."""
    first = rows.withColumn("_place", F.row_number().over(W.partitionBy(by).orderBy(order))).where(missed).groupBy(by, unit).agg(F.min("_place").alias("missed_at"))
    return first.withColumn("again_at", F.col("missed_at") + 3 + F.pmod(F.crc32(F.concat_ws("|", F.col(by).cast("string"), F.col(unit).cast("string"))), F.lit(3)))


def mixed_in(main: DataFrame, extra: DataFrame, by: str, order: str, most: int = 2, every: int = 3) -> DataFrame:
    """`main` with up to `most` extra rows of each key after every `every`-th place; columns (by, item, place)."""
    turn = lambda df: F.row_number().over(W.partitionBy(by).orderBy(order))
    a = main.withColumn("_p", turn(main).cast("double"))
    b = extra.withColumn("_p", turn(extra).cast("double")).where(F.col("_p") <= most).withColumn("_p", F.col("_p") * every + 0.5)
    both = a.select(by, F.col(order).alias("item"), "_p").unionByName(b.select(by, F.col(order).alias("item"), "_p"))
    return both.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("_p", "item"))).drop("_p")


def levels(debits: DataFrame, by: list[str], order: str, amount: str, base: int = 8, step: int = 7) -> DataFrame:
    """Rows (by, level): how many upgrades were bought: the next costs base + step * level, and only exact payments count.

    A level is reached by the first payment of its price after that of the level before, so the fold is over a key's ordered payments.
    """

    def pay(level: int, paid: float | None) -> tuple[int, None]:
        return level + (paid == base + step * level), None

    return fold(debits, by, [order], [amount], "level int", lambda: 0, pay, lambda level: (level,))
