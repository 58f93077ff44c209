"""Personal data: pattern matches, and terms that give them away.

Sanitisation by information theory. Protected entities are the kinds below. Around each
match lies a context of a few words. Over the whole corpus, a term's pointwise mutual
information with a kind's contexts, log2 p(kind | term) / p(kind), is compared with the most
that it can be, the information -log2 p(kind) that the kind itself carries. A term that
discloses more than GENERALISE of it is generalised, more than REMOVE of it removed, wherever it
stands: co-occurrence decides what discloses, and a text may give away what it does not spell out.

A term must stand LEAST times in a kind's contexts, whatever the size of the corpus. Counts and
the lexicon stay distributed; a lexicon of at most MAX_SMALL terms is sent to all executors, and a
larger one is joined to the terms of each text, with the same result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import ascii_lower, cut, small_batches, words

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE, REACH, LEAST = 0.6, 0.9, 6, 5
#: Terms that are sent to the executors as one dictionary; parts that a common term's rows are dealt to.
MAX_SMALL, SALTS = 200_000, 32
#: Characters that do not belong to a term at its ends.
EDGE = ".,;:!?()[]\"'"

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOWER = {c: c + 32 for c in range(65, 91)}


def emails(text: str) -> list[tuple[int, int]]:
    """Looks left and right of each @, so that long runs cost one pass."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four parts of a dotted chain are one match."""
    out = []
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts = list(re.finditer(r"[0-9]+", m[0]))
            for k in range(0, len(parts) - 3, 4):
                if all(len(x := p[0].lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts[k : k + 4]):
                    out.append((m.start() + parts[k].start(), m.start() + parts[k + 3].end()))
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = re.sub(r"[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return dict(zip(KINDS, (f(text) for f in (emails, addresses, cards, phones))))


def context_terms(text: str, found: dict) -> list[tuple[str, str]]:
    """(kind, term) for words near matches, each word once a kind."""
    if not any(found.values()):
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    taken = set()
    for kind in KINDS:
        for a, b in found[kind]:
            taken.update(range(bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)))
    out = []
    for kind in KINDS:
        near = set()
        for a, b in found[kind]:
            first, last = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
            near.update(range(max(0, first - REACH), min(len(spans), last + REACH)))
        for k in sorted(near - taken):
            term = text[starts[k] : ends[k]].strip(EDGE)
            if term:
                out.append((kind, term.translate(_LOWER)))
    return out


def _terms(text: Column) -> Column:
    """Array of the terms of a text; a word of EDGE characters alone is an empty term."""
    return F.transform(words(ascii_lower(text)), lambda w: F.btrim(w, F.lit(EDGE)))


def disclosing_terms(docs: DataFrame) -> DataFrame | None:
    """term, said (``generalise`` or ``remove``) of the terms that disclose a kind; None without matches.

    Counts cover all words of all documents. Only the totals of the kinds reach the driver.
    """
    small_batches(docs.sparkSession)

    def near(batches):
        for batch in batches:
            n = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    n.update(context_terms(text, base_spans(text)))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([t for _, t in n]), pa.array(list(n.values()), pa.int64())], names=["kind", "term", "n"])

    counts = cut(docs.select("text").mapInArrow(near, "kind string, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")))
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    often = counts.where(F.col("n") >= LEAST)
    each = docs.select(F.explode(_terms(F.col("text"))).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("seen"))
    # terms that are not judged are summed in one row, of null
    seen = cut(each.join(often.select("term").distinct(), F.col("w") == F.col("term"), "left").groupBy("term").agg(F.sum("seen").alias("seen")))
    all_words = seen.agg(F.sum("seen")).first()[0]
    lift = F.lit(None).cast("double")
    for kind, n in totals.items():
        lift = F.when(F.col("kind") == kind, F.lit(all_words / n)).otherwise(lift)
    # the most that a kind can be disclosed is log2(lift)
    share = F.log2(F.col("n") / F.col("seen") * F.col("lift")) / F.log2("lift")
    judged = often.join(seen, "term").withColumn("lift", lift).where("lift > 1").withColumn("share", share).where(F.col("share") >= GENERALISE)
    return cut(judged.groupBy("term").agg(F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise").alias("said")))


def _with_known(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``docs`` with known: the rows of the lexicon whose term stands in the text."""
    docs = docs.withColumn("key", F.xxhash64("text"))
    each = docs.select("doc_id", "key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).where("term <> ''").withColumn("salt", F.pmod("key", F.lit(SALTS)))
    salted = lexicon.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    known = each.join(salted, ["term", "salt"]).groupBy("doc_id", "key").agg(F.collect_set(F.struct("term", "said")).alias("known"))
    known = known.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "known")
    return docs.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "known")


class Said(dict):
    """What is said of each word; terms are looked up once a word."""

    def __init__(self, terms: dict[str, str]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> str | None:
        self[word] = out = self.terms.get(word.strip(EDGE).translate(_LOWER))
        return out


def disclose(text: str, said: Said) -> list[tuple[str, int, int]]:
    """All spans of a text: the kinds in order, then ``generalise`` and ``remove``, each by start.

    Words that a match overlaps are left to it.
    """
    found = base_spans(text)
    out = [(kind, a, b) for kind in KINDS for a, b in found[kind]]
    hits = {w for w in set(_WORD.findall(text)) if said[w]} if said.terms else ()
    if hits:
        spans = sorted((a, b) for _, a, b in out)
        starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        terms = []
        for m in _WORD.finditer(text):
            if m[0] in hits:
                k = bisect.bisect_left(starts, m.end())
                if not k or reach[k - 1] <= m.start():
                    term = m[0].strip(EDGE)
                    at = m.start() + m[0].index(term)
                    terms.append((said[m[0]], at, at + len(term)))
        out += sorted(terms)
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Matches become their kind in brackets, generalised terms ``[term]``, removed ones go."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == "remove" else "[term]" if kind == "generalise" else f"[{kind}]"]
        else:
            b = max(at, b)
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, with_text: bool = True, max_small: int = MAX_SMALL) -> DataFrame:
    """doc_id, spans (array of kind, start, end; code points, end exclusive) and, if asked for, sanitised text.

    Null and empty texts have no spans and an empty text. Repeated rows are treated alike,
    other columns are ignored, and an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = disclosing_terms(docs)
    small = found is None or found.count() <= max_small
    lexicon = dict(found.collect()) if small and found is not None else {}
    if not small:
        docs = _with_known(docs, found)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            said = [Said(lexicon)] * len(texts) if small else [Said({r["term"]: r["said"] for r in k or ()}) for k in batch.column("known").to_pylist()]
            spans = [disclose(t, s) for t, s in zip(texts, said)]
            cols = [batch.column("doc_id"), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind)]
            if with_text:
                cols.append(pa.array(map(redact, texts, spans), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "spans", "text"][: len(cols)])

    return docs.mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>" + ", text string" * with_text)
