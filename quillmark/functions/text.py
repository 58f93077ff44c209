"""Text expressions: Column in, Column out. No Python runs per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry nothing in a question.
STOP_WORDS = ("what", "happens", "if", "cannot", "the", "with", "to", "a", "an", "of", "is", "are", "does", "for", "in", "this", "will", "and", "or")
#: Strings that stand for no value.
EMPTY_VALUES = ("", "null", "none", "n/a")
#: Fixed value: a run of three or more of these is a leader.
LEADER = r"[.·•_‐-―\-]{3,}"
#: Fixed value: a code point that renderers use for an apostrophe, folded by hand.
STRAY_APOSTROPHE = ("\u11b1", "'")
#: Characters that fold to several: the ellipsis, fractions, trade and number signs.
SEVERAL = "\u2026\u2025\u00bc\u00bd\u00be\u2122\u2116\u2120"
BREAK = "\u0001"


@lru_cache(1)
def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility foldings to one character (for translate), and the ligatures that become several."""
    one, many = {STRAY_APOSTROPHE[0]: STRAY_APOSTROPHE[1]}, []
    for c in map(chr, (*range(0xA0, 0x2000), *range(0x2000, 0x2400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800))):
        to = unicodedata.normalize("NFKC", c)
        if to != c and len(to) == 1:
            one[c] = to
        elif "\ufb00" <= c <= "\ufb06" or c in SEVERAL:
            many.append((c, to))
    return "".join(one), "".join(one.values()), many


def squeeze(c: Column) -> Column:
    """Collapses white space of any kind, trims, lower-cases."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def normalise(c: Column) -> Column:
    """Form in which quotes and pages are compared."""
    source, target, many = _foldings()
    folded = F.translate(c, source, target)
    for a, b in many:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    # nothing folds in plain ASCII
    c = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)
    return squeeze(F.regexp_replace(c, LEADER, " "))


#: What parts the segments of a quote, and a sentence's end before a capital or a bracket.
PARTS, SENTENCE = r"[\n;]+|\.\.\.+|…", r"([.:!?])\s+([A-Z(])"


def segments(c: Column, least: int = 18) -> Column:
    """Separately checkable parts of a quote: lines, list items, sentences, what ellipses part."""
    marked = F.regexp_replace(c, PARTS, BREAK)
    marked = F.regexp_replace(marked, SENTENCE, f"$1{BREAK}$2")
    return F.filter(F.transform(F.split(marked, BREAK), normalise), lambda s: F.length(s) >= least)


def word_shingles(normal: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words of a normalised text; the words are bound once for the lambda."""
    bound = F.transform(F.array(F.split(normal, " ")), lambda w: F.array_distinct(F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: i <= F.size(w) - (size - 1)),
        lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))))
    return F.element_at(bound, 1)


def containment(part: Column, whole: Column) -> Column:
    """Share of ``part``'s elements that ``whole`` has; 0 for none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(part, whole)).cast("double"), F.size(part).cast("double")), F.lit(0.0))


def repair_clock(c: Column) -> Column:
    """``2.00 PM`` is ``2:00 PM``."""
    return F.regexp_replace(c, r"(\d{1,2})\.(\d{2})(\s*[AaPp][Mm])", "$1:$2$3")


#: Month names in English, whole or abbreviated; what may follow a day's number; two-digit years below this are of 2000.
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ORDINAL, PIVOT = r"(?:st|nd|rd|th)?", 69
YEAR = r"'?(\d{4}|\d{2})(?![\d:])"
#: Written forms: pattern, and which of its groups are year, month, day. A month's group is a number or a name.
DATE_FORMS = (
    (r"(?<![\d/.-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)", 1, 3, 4),
    (r"(?<![\d/.-])((?:19|20)\d{2})(\d{2})(\d{2})(?=t\d|\b)", 1, 2, 3),
    (rf"\b{MONTH}\s*(\d{{1,2}}){ORDINAL}(?:\s*,\s*|\s+)(?:of\s+)?{YEAR}", 3, 1, 2),
    (rf"(?<!\d)(\d{{1,2}}){ORDINAL}(?:\s+day)?(?:\s+of)?[\s/.-]*{MONTH}[\s,/.-]*(?:of\s+)?{YEAR}", 3, 2, 1),
    (rf"(?<!\d)(\d{{4}})[\s,/-]+{MONTH}[\s/-]+(\d{{1,2}}){ORDINAL}(?!\d)", 1, 2, 3),
    (r"(?<![\d/.-])(\d{1,2})([/.-])(\d{1,2})\2'?(\d{4}|\d{2})(?![\d/:])", 4, 1, 3),
)


def bind(c: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _day(found: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """The day that a match of a form names; null if there is none. A match is a match of its form by itself too, as no form
    looks farther than its ends forbid, so the groups are read from it and not from the whole text again."""
    y, m, d = (F.regexp_extract(found, pattern, k) for k in (year, month, day))
    if "jan" in pattern:
        m = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(MONTHS) for x in (name, str(k + 1))]), F.substring(m, 1, 3))

    def read(x: Column) -> Column:
        y, m, d = x["y"], x["m"], x["d"]
        if year == 4:
            swap = m.try_cast("int") > 12
            m, d = F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)
        y = F.when(F.length(y) == 2, F.when(y.try_cast("int") < PIVOT, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))).otherwise(y)
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")))

    return F.when(found != "", bind(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), read))


def extract_date(c: Column) -> Column:
    """The first whole date of a text; a clock or zone beside it does not shift it. Null if none is whole or real.

    Of two numbers before a year the first is the month, unless it is above 12. Years of two digits are of 1969 to 2068.
    Each form searches the text once; where its match stands is asked only if several forms have a day."""
    def earliest(t: Column, days: Column) -> Column:
        at = [F.when(days[k].isNotNull(), F.struct(F.regexp_instr(t, F.lit(form[0])).alias("at"), days[k].alias("day"))) for k, form in enumerate(DATE_FORMS)]
        several = F.size(F.filter(days, lambda x: x.isNotNull())) > 1
        return F.when(several, F.array_min(F.filter(F.array(*at), lambda x: x.isNotNull()))["day"]).otherwise(F.coalesce(*[days[k] for k in range(len(DATE_FORMS))]))

    def search(t: Column) -> Column:
        found = F.array(*[F.regexp_extract(t, form[0], 0) for form in DATE_FORMS])
        days = bind(found, lambda f: F.array(*[_day(f[k], *form) for k, form in enumerate(DATE_FORMS)]))
        return bind(days, lambda x: earliest(t, x))

    return F.when(c.rlike(r"\d"), bind(F.lower(repair_clock(c)), search))


#: Currencies by sign or code, and words that multiply an amount.
CURRENCIES = {"$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "c$": "CAD", "cad": "CAD"}
TIMES = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "million": 1_000_000, "billion": 1_000_000_000}
AMOUNT = r"(?i)(?<![a-z])(us\$|c\$|\$|€|£|usd|eur|gbp|cad)\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(million|billion|thousand|m\b|k\b)?|(?<![\d.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(million|billion|thousand)?\s*(usd|eur|gbp|cad|dollars|euros)\b"


def extract_amount(c: Column) -> Column:
    """The first amount of money in a text as currency, blank, number with two places; null without one."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    def worth(x: Column) -> Column:
        either = lambda a, b: F.coalesce(F.nullif(x[a], F.lit("")), F.nullif(x[b], F.lit("")))
        code = F.try_element_at(table(CURRENCIES | {"dollars": "USD", "euros": "EUR"}), either("g1", "g6"))
        number = F.replace(either("g2", "g4"), F.lit(",")).try_cast("decimal(24,6)") * F.coalesce(F.try_element_at(table(TIMES), either("g3", "g5")), F.lit(1))
        return F.concat(code, F.lit(" "), F.round(number, 2).cast("decimal(24,2)").cast("string"))

    return F.when(c.rlike(r"\d"), bind(F.struct(*[F.lower(F.regexp_extract(c, AMOUNT, k)).alias(f"g{k}") for k in range(1, 7)]), worth))


def has_time(c: Column) -> Column:
    return c.rlike(r"T\d\d:\d\d|\d{1,2}:\d{2}|\d\s*[AaPp][Mm]\b")


def first_email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0), F.lit(""))


def leading_name(c: Column) -> Column:
    return F.trim(F.split(c, "[,;.]").getItem(0))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def is_content(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*EMPTY_VALUES)


def has_content(text: Column, items: Column, members: Column) -> Column:
    """As ``is_content`` for texts; a list needs an item with content, a map a member."""
    listed = F.exists(items, lambda x: is_content(x))
    return F.coalesce(is_content(text), F.lit(False)) | F.coalesce(listed, F.lit(False)) | F.coalesce(F.cardinality(members) > 0, F.lit(False))


#: What the scanner of cut records stops at: an escaped character, a quotation mark, a bracket, or a run of others.
JSON_PIECES = r"""(?s)\\.|["{}\[\]]|[^"{}\[\]\\]+|\\"""


def closed_part(c: Column) -> Column:
    """A JSON object that was cut off, up to its last whole object-valued member, and closed; null if there is none.

    Brackets are counted outside strings; escaped quotation marks end no string."""
    pieces = F.regexp_extract_all(c, F.lit(JSON_PIECES), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("good"))

    def step(s: Column, piece: Column) -> Column:
        escaped = F.startswith(piece, F.lit("\\")) & (F.length(piece) == 2)
        x = F.when(escaped, F.when(s["quoted"], F.lit("")).otherwise(F.substring(piece, 2, 1))).otherwise(piece)
        at = s["at"] + F.length(piece)
        opens, closes = ~s["quoted"] & x.isin("{", "["), ~s["quoted"] & x.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), (s["quoted"] != (x == '"')).alias("quoted"),
                        F.when(closes & (depth == 1) & (x == "}"), at).otherwise(s["good"]).alias("good"))

    good = F.aggregate(pieces, zero, step, lambda s: s["good"])
    return F.when(F.startswith(c, F.lit("{")) & (good > 0), F.concat(F.substring(c, F.lit(1), good), F.lit("}")))


def truthy(c: Column) -> Column:
    """Any text but the empty one is true; null is not."""
    return F.coalesce(c != "", F.lit(False))


def question_tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("?"), F.lit("")), r"\s+", " ")), " "), lambda w: ~w.isin(*STOP_WORDS) & (w != ""))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def file_key(c: Column) -> Column:
    return F.translate(c, ":/", "--")


def token_set_similarity(a: Column, b: Column) -> Column:
    """0 to 100: 100 if one word set holds the other, else the best of the closed forms for the
    common part against either whole, and the edit distance of what is left of both.

    An approximation of a character-aligned score, not the same scale.
    """
    def compare(w: Column) -> Column:
        both = F.array_join(F.array_sort(F.array_intersect(w["a"], w["b"])), " ")
        ra, rb = (F.array_join(F.array_sort(F.array_except(w[x], w[y])), " ") for x, y in ("ab", "ba"))
        return bind(F.struct(F.length(both).alias("n"), ra.alias("ra"), rb.alias("rb"), F.length(ra).alias("la"), F.length(rb).alias("lb")), closest)

    def closest(x: Column) -> Column:
        n, la, lb = x["n"], x["la"], x["lb"]
        full = lambda m: n + F.when((n > 0) & (m > 0), 1).otherwise(0) + m
        close = lambda m: F.when(n > 0, 100.0 * 2 * n / (n + full(m))).otherwise(0.0)
        longer = F.greatest(la, lb, F.lit(1))

        def edited(best: Column) -> Column:
            # more edits than these leave less than the best so far; they are not counted out
            most = F.ceil(longer * (1 - best / 100.0)).cast("int") + 1
            apart = F.call_function("levenshtein", x["ra"], x["rb"], most)
            return F.when(F.abs(la - lb) > most, best).otherwise(bind(apart, lambda n: F.when(n < 0, best).otherwise(F.greatest(best, 100.0 * (1 - n / longer)))))

        return F.when((n > 0) & ((la == 0) | (lb == 0)), 100.0).otherwise(bind(F.greatest(close(la), close(lb)), edited))

    words = lambda c: F.array_distinct(F.split(squeeze(c), " "))
    return F.when(a.isNotNull() & b.isNotNull(), bind(F.struct(words(a).alias("a"), words(b).alias("b")), compare))
