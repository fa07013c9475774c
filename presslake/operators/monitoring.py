"""What checks of a page make of its publication: a state machine per page, folded over its history (STR-11).

A page that its source has removed goes back to review, and what it was before is remembered until a
check that finds the page there restores it; checks that fail for a time change nothing but the count of
failures. All of it follows from the numbers of a page's last removal, its last check that found it and
its last one that didn't fail, and from its first removal: running maxima and a minimum. A page's
history is cut into spans of time: a span is summed up in a row, the rows of a page are added up, and
checks are numbered inside their span, so that a page with most of all checks is spread over its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results of a check that don't tell whether the page is there, and the one that says it isn't (fixed values).
TEMPORARY, REMOVED = ("Unavailable", "Temporarily Unreachable"), "Removed"
PUBLISHED, REVIEW = "published", "review"
STATE = ("attempts", "failures", "publication", "previous", "removed_at", "hidden", "restored")


def page_states(checks: DataFrame, page: str, at: str, number: str, status: str, initial: Column, refreshed: Column | None = None, span: str = "day") -> DataFrame:
    """checks with the state that each leaves its page in: attempts, failures (since the last answer), publication, previous (what it was before its removal), removed_at, hidden and restored.

    A page's checks are in the order of ``at`` and ``number``; those without a time come first. ``initial`` is the
    publication that a page had at first, the same for all its checks. ``refreshed`` is false where the page was there
    but couldn't be read again: such a check restores nothing. A null status counts as one that finds the page.
    """
    taken = {c for c in checks.columns if c in STATE or c.startswith("_")}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)}")
    result = F.coalesce(F.col(status), F.lit("Active"))
    temporary, removed = result.isin(*TEMPORARY), result == REMOVED
    found = ~temporary & ~removed & (F.lit(True) if refreshed is None else F.coalesce(refreshed, F.lit(True)))
    own = checks.withColumns({"_span": F.date_trunc(span, at), "_first": initial, "_temporary": temporary, "_removed": removed, "_found": found})
    inside = Window.partitionBy(page, "_span").orderBy(F.col(at).asc_nulls_first(), F.col(number).asc_nulls_first())
    own = own.withColumn("_n", F.row_number().over(inside).cast("long"))
    # by number: the last answer, the last check that found the page, the last removal with its time, the first removal
    answer, seen, first_gone = (F.when(c, F.col("_n")) for c in (~F.col("_temporary"), F.col("_found"), F.col("_removed")))
    gone = F.when(F.col("_removed"), F.struct("_n", F.col(at).alias("at")))
    sums = own.groupBy(page, "_span").agg(F.count("*").alias("n"), F.max(answer).alias("answer"), F.max(seen).alias("seen"), F.max(gone).alias("gone"), F.min(first_gone).alias("first_gone"))
    earlier = Window.partitionBy(page).orderBy(F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    shifted = lambda c: F.col("_offset") + c
    shifted_gone = lambda c: F.when(c.isNotNull(), F.struct(shifted(c["_n"]).alias("_n"), c["at"].alias("at")))
    carried = sums.select(
        F.col(page).alias("_page"),
        F.col("_span").alias("_of"),
        "_offset",
        F.max(shifted(F.col("answer"))).over(earlier).alias("_answer"),
        F.max(shifted(F.col("seen"))).over(earlier).alias("_seen"),
        F.max(shifted_gone(F.col("gone"))).over(earlier).alias("_gone"),
        F.min(shifted(F.col("first_gone"))).over(earlier).alias("_first_gone"),
    )
    both = own.join(carried, F.col(page).eqNullSafe(F.col("_page")) & F.col("_span").eqNullSafe(F.col("_of")))
    now, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda c, carry, frame: F.coalesce(F.max(shifted(c)).over(frame), F.col(carry), F.lit(0))
    both = both.withColumns({
        "_seen_now": latest(seen, "_seen", now),
        "_seen_before": latest(seen, "_seen", before),
        "_gone_now": F.coalesce(shifted_gone(F.max(gone).over(now)), F.col("_gone")),
        "_gone_before": latest(first_gone, "_gone._n", before),
        "_answer_now": latest(answer, "_answer", now),
        "_first_now": F.coalesce(F.col("_first_gone"), shifted(F.min(first_gone).over(now))),
    })
    away = F.coalesce(F.col("_gone_now._n"), F.lit(0)) > F.col("_seen_now")
    was_away = F.col("_gone_before") > F.col("_seen_before")
    published = F.col("_first") == PUBLISHED
    # one that was neither published nor in review comes back for review
    home = F.when(published | F.col("_first_now").isNull(), F.col("_first")).otherwise(REVIEW)
    state = {
        "attempts": shifted(F.col("_n")),
        "failures": shifted(F.col("_n")) - F.col("_answer_now"),
        "publication": F.when(away, REVIEW).otherwise(home),
        "previous": F.when(away, F.when(published | (F.col("_seen_now") < F.col("_first_now")), F.col("_first")).otherwise(REVIEW)),
        "removed_at": F.when(away, F.col("_gone_now.at")),
        "hidden": F.col("_removed") & ~was_away & published,
        "restored": F.col("_found") & was_away & published,
    }
    return both.select(*checks.columns, *(state[c].alias(c) for c in STATE))
