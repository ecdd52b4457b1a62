"""Text functions as column expressions: normal forms, matching, figures, shapes. No Python runs in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: letters of the six languages with marks, and what they are without.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
UNMARKED = "aaaaaaeeeeiiiiooooouuuucnyy"
# Fixed value: the HTML entities that headlines carry.
ENTITIES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def bare(text: Column) -> Column:
    """Lower case without accents; combining marks are dropped and ß is written ss."""
    lower = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.translate(lower, MARKED, UNMARKED), "[\\u0300-\\u036f]+", "")


def alnum_key(text: Column) -> Column:
    """Letters and digits of the bare form, nothing between them."""
    return F.regexp_replace(bare(text), "[^\\p{L}\\p{N}]+", "")


def spaced_key(text: Column) -> Column:
    """Words of the bare form, one blank between them."""
    return F.trim(F.regexp_replace(bare(text), "[^\\p{L}\\p{N}]+", " "))


def clean_title(text: Column, replacements: dict[str, str] | None = None) -> Column:
    """Entities resolved, typographic quotes made straight, given patterns replaced in order, white space collapsed."""
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.translate(text, "“”„«»‘’", "\"\"\"\"\"''")
    for pattern, by in (replacements or {}).items():
        text = F.regexp_replace(text, pattern, by)
    return F.nullif(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(""))


def without_suffix(title: Column, outlet: Column, separators: tuple[str, ...] = (" - ", " | ", " – ")) -> Column:
    """The title without a final outlet name after a separator, if what stays has at least three words."""
    result = title
    for separator in separators:
        tail = F.substring_index(title, separator, -1)
        head = F.substring(title, F.lit(1), F.length(title) - F.length(tail) - len(separator))
        named = title.contains(separator) & (alnum_key(tail) == alnum_key(outlet)) & (F.size(F.split(head, " ")) >= 3)
        result = F.when(named, head).otherwise(result)
    return result


def has_word(text: Column, word: str) -> Column:
    """Whether the word or phrase stands in the text, without accents and case, not inside another word."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return bare(text).rlike(r"(?<![\p{L}\p{N}_])" + re.escape(plain) + r"(?![\p{L}\p{N}_])")


def has_acronym(text: Column, acronym: str) -> Column:
    """Case counts: the acronym as it is, not inside another word."""
    import re

    return text.rlike(r"(?<![\p{L}\p{N}_])" + re.escape(acronym) + r"(?![\p{L}\p{N}_])")


def has_term(text: Column, term: str, before: tuple[str, ...] = (), not_after: tuple[str, ...] = ()) -> Column:
    """Whether a word stands in the text and isn't preceded by one of ``before`` nor followed by one of ``not_after``."""
    import re

    behind = "".join(rf"(?<!\b{re.escape(w)} )" for w in before)
    ahead = "".join(f"(?! {re.escape(w)})" for w in not_after)
    return bare(text).rlike(behind + r"\b" + re.escape(term) + r"\b" + ahead)


def words(text: Column, stop: tuple[str, ...] = (), least: int = 2) -> Column:
    """Words of the bare form of at least ``least`` letters that aren't stop words, in order."""
    every = F.split(spaced_key(text), " ")
    stopped = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(every, lambda w: (F.length(w) >= least) & ~F.array_contains(stopped, w))


def shape(text: Column) -> Column:
    """Format of a value: runs of digits become 9, runs of letters a."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), "\\p{L}+", "a")


def shorten(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length - 1)), F.lit("…"))).otherwise(text)


def without_delimiters(text: Column, tag: str) -> Column:
    """The text without opening and closing tags of that name, so that it can't end a quoted passage."""
    return F.regexp_replace(text, rf"(?i)</?\s*{tag}\b[^>]*>", "")


def holds(text: Column, part: Column) -> Column:
    """Whether a passage stands literally in the text once white space is collapsed; an empty passage doesn't."""
    flat = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    return (flat(part) != "") & flat(text).contains(flat(part))


def any_of(terms: list[str]) -> str:
    """A search expression: terms joined by OR in brackets, phrases in quotes."""
    return "(" + " OR ".join(f'"{t}"' if " " in t else t for t in terms) + ")"


def escape_markdown(text: Column) -> Column:
    """Backslashes before the characters that Markdown reads, line breaks as blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1"), "[\r\n]+", " ")


def number_text(value: Column, decimals: int = 2) -> Column:
    """Thousands in groups, at most so many decimals, no final zeros."""
    return F.regexp_replace(F.format_number(value, decimals), r"\.?0+$" if decimals else "$^", "")


NUMERAL = r"\d+(?:[.,]\d{3})*(?:[.,]\d+)?"


def numeral(text: Column) -> Column:
    """The value of a numeral: groups of three digits after the first separator are thousands, else decimals."""
    grouped = text.rlike(r"^\d{1,3}([.,]\d{3})+$")
    mixed = text.rlike(r"^\d{1,3}(\.\d{3})+,\d+$")
    english = text.rlike(r"^\d{1,3}(,\d{3})+\.\d+$")
    return (
        F.when(grouped, F.regexp_replace(text, "[.,]", ""))
        .when(mixed, F.translate(F.replace(text, F.lit("."), F.lit("")), ",", "."))
        .when(english, F.replace(text, F.lit(","), F.lit("")))
        .otherwise(F.translate(text, ",", ".")).try_cast("double")
    )


def figures(text: Column, stem: int = 5) -> Column:
    """Array of (value, unit): each figure with the stem of the next word; years and clock times are left out."""
    found = F.regexp_extract_all(bare(text), F.lit(rf"((?<![\d:./-]){NUMERAL}(?![\d:/-]))(?:\s+(\p{{L}}+))?"), F.lit(0))
    split = F.transform(found, lambda m: F.struct(
        numeral(F.regexp_extract(m, rf"^({NUMERAL})", 1)).alias("value"), F.substring(F.regexp_extract(m, r"\s(\p{L}+)$", 1), 1, stem).alias("unit")
    ))
    return F.filter(split, lambda s: s["value"].isNotNull() & ~((s["value"] >= 1900) & (s["value"] <= 2100) & (s["value"] == F.floor(s["value"]))))


def proper_names(text: Column, least: int = 3) -> Column:
    """Words with a capital that don't open a sentence, in order; one that does counts if another such word follows it at once."""
    w = F.split(F.trim(F.regexp_replace(text, "\\s+", " ")), " ")
    core = lambda x: F.regexp_replace(x, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    capital = lambda x: core(x).rlike("^\\p{Lu}") & (F.length(core(x)) >= least)

    def named(i: Column) -> Column:
        here, before, after = F.get(w, i), F.coalesce(F.get(w, i - 1), F.lit("")), F.coalesce(F.get(w, i + 1), F.lit(""))
        opens = (i == 0) | before.rlike("[.?!:;¿¡«\"“(—\\[-]$")
        joined = capital(after) & here.rlike("[\\p{L}\\p{N}]$") & after.rlike("^[\\p{L}\\p{N}]")
        return capital(here) & (~opens | joined)

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), named), lambda i: core(F.get(w, i)))


PERCENTAGE = r"(\d+(?:[.,]\d+)?)\s*(?:%|por ciento)"


def bound_percentage(sentence: Column, words: tuple[str, ...], window: int = 40) -> tuple[Column, Column]:
    """(value, kind) of the one percentage of a sentence, if one of ``words`` stands before it, ``window`` characters at most.

    Between them a verb of change makes it a ``variacion`` (negative for a fall), one followed by ``a`` or ``hasta`` the
    ``nivel`` reached, none a ``nivel``; words of approximation, other figures or a second percentage give null.
    """
    every = F.array_distinct(F.regexp_extract_all(sentence, F.lit(PERCENTAGE), F.lit(1)))
    pattern = f"(?:{'|'.join(words)})([^0-9%]{{0,{window}}}?){PERCENTAGE}"
    between, found = F.regexp_extract(sentence, pattern, 1), F.regexp_extract(sentence, pattern, 2)
    clear = (F.size(every) == 1) & (found != "") & (found == F.get(every, F.lit(0))) & ~between.rlike("(casi|cerca de|menos de|más de|unos|unas)")
    value = F.translate(found, ",", ".").try_cast("double")
    fall, rise = "(cayeron|cayó|bajaron|bajó)", "(subieron|subió|crecieron|creció)"
    reached = between.rlike(rf"({fall}|{rise})\s+(a|hasta)\s*$")
    kind = F.when(reached, "nivel").when(between.rlike(f"{fall}|{rise}"), "variacion").otherwise("nivel")
    signed = F.when(~reached & between.rlike(fall), -value).otherwise(value)
    return F.when(clear, signed), F.when(clear, kind)
