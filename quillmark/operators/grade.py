"""Type-aware comparison of answers with truth. All verdicts are expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.serve import row_name, variant_items
from quillmark.sources.tables import variant_kind

#: Shares of list items, similarities of items and of free text.
RECALL_GOOD, RECALL_SOME, ITEM, TEXT_GOOD, TEXT_SOME = 0.8, 0.4, 65.0, 70.0, 40.0


def presence(truth_present: Column, answered: Column, answer_present: Column, content: Column, verdict: Column) -> Column:
    """missing without an answer; absent truth wants an absent answer; an answer that denies itself
    but has content is still compared."""
    return (F.when(~answered, "missing").when(~truth_present, F.when(answer_present, "wrong").otherwise("correct"))
            .when(~answer_present & ~content, "wrong").otherwise(verdict))


def date_verdict(truth: Column, answer: Column) -> Column:
    def judged(x: Column) -> Column:
        t, a = x["t"], x["a"]
        return (F.when(truth.isNull(), "correct").when(a.isNull() | t.isNull(), "wrong").when(a != t, "wrong")
                .when(T.has_time(answer) & ~T.has_time(truth), "partial").otherwise("correct"))

    return T.bind(F.struct(T.extract_date(truth).alias("t"), T.extract_date(answer).alias("a")), judged)


def number_verdict(truth: Column, answer: Column) -> Column:
    return F.when(truth.isNull() | answer.isNull(), "wrong").when(truth == answer, "correct").otherwise("wrong")


def any_number_verdict(truths: Column, answer: Column) -> Column:
    return F.when(F.coalesce(F.exists(truths, lambda x: x == answer), F.lit(False)), "correct").otherwise("wrong")


def boolean_verdict(truth: Column, answer: Column) -> Column:
    return F.when(F.coalesce(truth, F.lit(False)) == F.coalesce(answer, F.lit(False)), "correct").otherwise("wrong")


def contact_verdict(truth: Column, answer_text: Column) -> Column:
    low, mail, name = F.lower(answer_text), F.lower(T.first_email(truth)), F.lower(T.leading_name(truth))
    return F.when((F.instr(low, mail) > 0) | ((F.length(name) > 0) & (F.instr(low, name) > 0)), "correct").otherwise("partial")


def item_set(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, T.squeeze), lambda x: x != ""))


def variant_set(v: Column) -> Column:
    """The items of a VARIANT list or table by the member that names them, squeezed, each once; a bare value is a list of one."""
    return item_set(F.when(variant_kind(v) == "null", F.array().cast("array<string>")).otherwise(F.transform(variant_items(v), row_name)))


def list_recall(truth: Column, answer: Column) -> Column:
    found = F.filter(truth, lambda t: F.exists(answer, lambda a: T.token_set_similarity(t, a) >= ITEM))
    return F.try_divide(F.size(found).cast("double"), F.size(truth).cast("double"))


def banded(score: Column, good: float, some: float) -> Column:
    return F.when(score.isNull(), "correct").when(score >= good, "correct").when(score >= some, "partial").otherwise("wrong")


def mismatch(verdict: Column, similarity: Column, coverage: Column) -> Column:
    """A partial or wrong verdict that the numbers put near a better one."""
    near = similarity.between(60, 99.999999) | (coverage >= 0.8) & (coverage < 1)
    return verdict.isin("partial", "wrong") & F.coalesce(near, F.lit(False))


def with_truth(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """truth with each backend that answered anything in the document; unanswered fields stay, as nulls."""
    ran = answers.select("backend", "doc_id").distinct()
    return truth.join(ran, "doc_id").join(answers.withColumn("answered", F.lit(True)), ["backend", "doc_id", "field_key"], "left")


def cached(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a stored verdict, and those still to be judged."""
    return rows.join(cache, "key"), rows.join(cache, "key", "left_anti")


def share(c: Column) -> Column:
    """A stated coverage, held between 0 and 1; null is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def diagnostics(graded: DataFrame) -> DataFrame:
    """Everything that is not correct, with truth and answer side by side, the worst first."""
    order = F.when(F.col("verdict") == "missing", 0).when(F.col("verdict") == "wrong", 1).otherwise(2)
    return graded.where("verdict <> 'correct'").withColumn("severity", order)
