"""Scalar text functions of citation resolution, as native Column expressions.

Java regular expressions carry (?U) where Unicode classes are meant and (?iu) where letters of either case are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------------
#: Particles that may stand before a surname.
PARTICLES = ("van", "von", "de", "du", "da", "di", "del", "della", "der", "den", "het", "dos", "das", "do", "le", "la", "ten", "ter", "te")
#: "And others" in a list of authors.
ET_AL = r"(?iu:et\.?\s+al\.?|m\.?\s*fl\.?)"
#: A year: four digits and perhaps a letter, or a word for one that isn't known.
YEAR = r"(?:\d{4}[a-z]?|(?:[Ff]orthcoming|[Ii]n\s+[Pp]ress|[Aa]ccepted|[Nn]\.?\s*[Dd]\.?|[Uu]npublished))"
LOCATOR = r"(?:,|\s*:)\s*(pp?\.\s*|ch\.\s*|sec\.\s*)?(\d{1,4}(?:\s*[–\-]\s*\d{1,4})?)"
#: Headings of a list of references.
HEADINGS = ("references", "bibliography", "works cited", "literature cited", "reference list", "sources", "literature", "referanser", "litteraturliste", "referencias", "bibliographie")
#: A reference entry that names an author and a year: particles, surname, anything, a year that is set off.
AUTHOR_YEAR_ENTRY = r"(?iuU)^(?:(?:" + "|".join(PARTICLES) + r")\s+)*([A-Z][A-Za-zÀ-ÿ'\-]{1,30}).*?(?:\(|\.\s*|,\s*)(" + YEAR + r")(?:\)|[.\s,;])"
#: A numbered reference entry: "[1] text" or "1. text".
NUMBERED_ENTRY = r"(?U)^\s*(?:\[(\d+)\]|(\d+)\.)\s+(.+)$"
# ----------------------------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The words of a text, split at white space of any kind."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def is_particle(w: Column) -> Column:
    return F.lower(w).isin(*PARTICLES)


def normalize_year(c: Column) -> Column:
    """The first four digits, or one word for each kind of year that isn't a number."""
    word = F.regexp_replace(F.lower(c), r"(?U)[\s.]+", "")
    return (
        F.when(c.rlike(r"(?U)^\d{4}"), F.substring(c, 1, 4))
        .when(word.startswith("forth"), "forthcoming")
        .when(word.contains("press") | word.startswith("inp"), "inpress")
        .when(word.startswith("accept"), "accepted")
        .when(word.startswith("unpub"), "unpublished")
        .otherwise(word)
    )


def split_authors(c: Column) -> Column:
    """The surnames of a list of authors, without "and others", initials and possessives."""
    parts = F.split(F.regexp_replace(c, r"(?U)\s+" + ET_AL, ""), r"(?U)\s*(?:[,&]|\band\b)\s*")
    bare = F.transform(parts, lambda p: F.regexp_replace(strip(F.regexp_replace(p, r"(?U)^(?:(?:[A-Z]\.[\s-]*)|(?:[A-Z]\s+))+", "")), r"['’]s$", ""))
    return F.filter(bare, lambda p: p != "")


def first_surname_key(c: Column) -> Column:
    """The first word that is neither a particle nor an initial, in lower case; the first word if there is none."""
    all_words = words(c)
    names = F.filter(all_words, lambda w: ~is_particle(w) & ~w.rlike(r"(?U)^\p{Lu}\.?$"))
    return F.lower(F.coalesce(F.get(names, 0), F.get(all_words, 0), c))


def display_text(authors: Column, year: Column, et_al: Column) -> Column:
    """(A, y), (A & B, y) or (A et al., y)."""
    first, n = F.get(authors, 0), F.size(authors)
    return (
        F.when(n <= 0, F.when(year != "", F.concat(F.lit("("), year, F.lit(")"))).otherwise(""))
        .when(~et_al & (n == 1), F.concat(F.lit("("), first, F.lit(", "), year, F.lit(")")))
        .when(~et_al & (n == 2), F.concat(F.lit("("), first, F.lit(" & "), F.get(authors, 1), F.lit(", "), year, F.lit(")")))
        .otherwise(F.concat(F.lit("("), first, F.lit(" et al., "), year, F.lit(")")))
    )


def locator(c: Column) -> Column:
    """The first locator of a text as a struct of value and label; "" and "page" if there is none."""
    kind = F.lower(F.regexp_extract(c, "(?U)" + LOCATOR, 1))
    label = F.when(kind.startswith("ch"), "chapter").when(kind.startswith("sec"), "section").otherwise("page")
    return F.struct(strip(F.regexp_extract(c, "(?U)" + LOCATOR, 2)).alias("value"), label.alias("label"))


def reference_entry(c: Column) -> Column:
    """The authors and year of a reference entry as a struct."""
    year = F.regexp_extract(c, r"(?U)\b(\d{4}[a-z]?)\b", 1)
    before = F.when(year != "", F.get(F.split(c, r"(?U)\b\d{4}[a-z]?\b", 2), 0)).otherwise(F.substring(c, 1, 50))
    chunk = F.regexp_replace(strip(before), r"(?U)[\s,.()\[\]]+$", "")
    return F.struct(F.when(chunk != "", split_authors(chunk)).otherwise(F.array().cast("array<string>")).alias("authors"), year.alias("year"))


def strip_particles(c: Column) -> Column:
    """Without particles in front, as long as a word remains; single spaces between words."""
    w = words(c)
    first = F.coalesce(F.array_position(F.transform(w, is_particle), False), F.lit(0))
    keep = F.when(first == 0, F.size(w)).otherwise(first)
    return F.when(c.isNull(), F.lit(None)).when(F.size(w) > 0, F.array_join(F.slice(w, F.greatest(keep.cast("int"), F.lit(1)), F.greatest(F.size(w), F.lit(1))), " ")).otherwise("")


#: Numbers of a span at most; a longer range is several spans, so no array grows with it.
SPAN = 10_000


def number_spans(c: Column) -> Column:
    """The numbers of "1, 3-5" as spans (low, high) of SPAN numbers at most: ranges run upwards, what isn't a number is passed over."""
    parts = F.split(strip(c), r"(?U),\s*")

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, r"(?U)^(\d+)\s*[–\-]\s*(\d+)", 1).try_cast("int")
        b = F.regexp_extract(p, r"(?U)^(\d+)\s*[–\-]\s*(\d+)", 2).try_cast("int")
        n = strip(p).try_cast("int")
        span = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
        none = F.array().cast("array<struct<low:int,high:int>>")
        starts = F.sequence(a.cast("long"), b.cast("long"), F.lit(SPAN).cast("long"))
        ranges = F.transform(starts, lambda x: span(x, F.least(x + F.lit(SPAN - 1), b.cast("long"))))
        return F.when(a.isNotNull() & b.isNotNull(), F.when(b >= a, ranges).otherwise(none)).otherwise(F.when(n.isNotNull(), F.array(span(n, n))).otherwise(none))

    return F.flatten(F.transform(parts, one))
