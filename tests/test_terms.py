"""Tags and categories of texts against what the rules say, with the letters that the rules are about."""

import pytest
from pyspark.sql import functions as F

from presslake.functions import compat
from presslake.operators import repairs
from presslake.operators import terms as T

TOPICS = {
    "الاقتصاد والأسواق": ["اقتصاد", "استثمار", "اسهم", "تضخم", "ذهب"],
    "التقنية والتحول الرقمي": ["تقنيه", "رقمي", "سيبراني"],
}
ROW = "title string, body string, category string, region string, source string, domain string, tags_ string"


def tagged(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    own = T.Dictionaries(TOPICS)
    found = T.semantic_tags(df, F.col("title"), F.col("body"), own, category=F.col("category"), region=F.col("region"), source=F.col("source"), domain=F.col("domain"), **more)
    return [(r.tags, r.keyphrases) for r in found.collect()]


def test_topics_places_and_phrases(spark):
    [(tags, phrases)] = tagged(spark, [("ارتفاع أسعار الذهب مع ترقب بيانات التضخم الأمريكية", "ارتفع الذهب في الأسواق العالمية مع انتظار المستثمرين بيانات اقتصادية جديدة في الولايات المتحدة.", "الاقتصاد", None, "صحيفة المثال", "example.com")])
    assert "الاقتصاد" in tags and "الولايات المتحدة" in tags and "الاقتصاد والأسواق" in tags
    assert tags[0] == "الاقتصاد" and any(" " in p for p in phrases)


def test_no_words_of_the_source_and_no_repeats(spark):
    [(tags, _)] = tagged(spark, [("سبق تطلق تقريرًا عن التقنية والتحول الرقمي", "يتناول التقرير تطبيقات التقنية والتحول الرقمي في مدينة الرياض.", "التقنية", "الرياض", "صحيفة سبق", "sabq.org")])
    assert not any("سبق" in t or "sabq" in t for t in tags) and len(set(tags)) == len(tags)
    assert tags.count("الرياض") == 1 and tags[0] == "التقنية"  # the region's nine points, once, not the place's seven


def test_names_hold_five_words_at_most_and_limits_apply(spark):
    row = ("وزارة الصحة والسكان في البلاد تعلن خطة", "السعودية مكة جدة الدمام تبوك عسير نجران جازان", "الصحة", None, None, None)
    [(tags, phrases)] = tagged(spark, [row])
    assert "وزارة الصحة والسكان في البلاد" in tags and len(tags) == 8 and phrases == ["وزارة الصحة والسكان في البلاد"]
    assert "السعودية" not in tags
    assert tagged(spark, [row], tags=2) == [(tags[:2], phrases)]


def test_nulls_and_empty_texts(spark):
    assert tagged(spark, [(None,) * 6, ("", "", "", "", "", "")]) == [([], []), ([], [])]
    with pytest.raises(ValueError, match="hits_"):
        T.term_hits(spark.createDataFrame([("a", 1)], "text string, hits_ int"), {"hits_": "text"}, ["a"])


@pytest.mark.parametrize("part", [1, 2, T.PART])
def test_hits_of_overlapping_repeated_and_empty_terms(spark, part):
    df = spark.createDataFrame([("abcab",), ("",), (None,), ("c" * 100_000 + "abc",)], "text string")
    found = T.term_hits(df, {"hits": "text"}, ["ab", "abc", "b", "", "ab", "z"], part)
    assert [r.hits for r in found.collect()] == [[0, 1, 2, 4], [], [], [0, 1, 2, 4]]


POLICIES = {
    "الاقتصاد": T.Policy(strong=["اسواق المال", "التضخم"], helper=["اقتصاد", "اسهم", "ذهب", "عمله", "اسعار"], entity=["البنك المركزي"], exclude=["مباراه"]),
    "السياسة": T.Policy(strong=["رئيس الوزراء", "اتفاق سياسي"], helper=["حكومه", "دبلوماسي"], entity=["مجلس الامن"], exclude=["اسعار", "اسهم"]),
    "المجتمع": T.Policy(strong=["حادث مروري", "حادث انقلاب"], helper=["حادث", "وفاه", "اصابه"]),
    "السيارات": T.Policy(strong=["سوق السيارات", "موديل جديد"], helper=["سيارات", "مركبه", "موديل"], entity=["تويوتا"], exclude=["حادث انقلاب", "وفاه", "اسعاف"], minimum=9, specialised=True),
}
STORIES = [
    ("الذهب يبلغ أعلى مستوياته مع ترقب بيانات التضخم", "ارتفعت أسعار الذهب في الأسواق العالمية مع ترقب المستثمرين بيانات التضخم وحركة العملة."),
    ("رئيس الوزراء يبحث اتفاقًا سياسيًا وعلاقات دولية جديدة", "ناقشت الحكومة والمجلس ملفات المفاوضات الدبلوماسية والاتفاق السياسي بين الدولتين."),
    ("مصرع وإصابة أشخاص في حادث انقلاب مركبة على الطريق", "باشرت فرق الإسعاف حادثًا مروريًا أسفر عن وفاة وإصابات بعد انقلاب المركبة."),
    ("شركة سيارات تكشف موديلًا كهربائيًا جديدًا", "أعلنت تويوتا طرح موديل جديد في سوق السيارات ببطارية محسنة وتقنيات قيادة حديثة."),
    ("خبر بلا علامات", None),
]


def points(title, body):
    """Scores by hand: a term counts once, as it is or without articles."""
    bare = lambda t: " ".join(w[2:] if w.startswith("ال") and len(w) > 3 else w for w in t.split())
    title, body = T.folded(title or ""), T.folded(body or "")
    out = {}
    for name, policy in POLICIES.items():
        score, titled = 0.0, False
        for role, (high, low) in T.WEIGHTS.items():
            for term in map(T.folded, getattr(policy, role)):
                holds = lambda text: term in text or (len(bare(term)) > 2 and bare(term) in bare(text))  # noqa: B023, E731
                if holds(title):
                    score, titled = score + high, titled or role != "exclude"
                elif holds(body):
                    score += low
        out[name] = max(0.0, score - 6) if policy.specialised and not titled and score > 0 else score
    return out


def test_categories_equal_a_count_by_hand(spark):
    found = T.classify(spark.createDataFrame(STORIES, "title string, body string"), F.col("title"), F.col("body"), POLICIES).collect()
    for (title, body), row in zip(STORIES, found):
        ranked = sorted(points(title, body).items(), key=lambda x: -x[1])
        c = row.classification
        assert (c.category, c.score, c.margin) == (*ranked[0], ranked[0][1] - ranked[1][1])
        assert [(a.category, a.score) for a in c.alternatives] == ranked[1:4]
    assert [r.classification.category for r in found[:4]] == list(POLICIES)
    assert [r.classification.needs_review for r in found] == [False, False, False, False, True]
    assert found[4].classification.reasons == ["below_category_threshold"] and found[4].classification.confidence == 35


def test_a_source_of_one_section_bounds_the_categories(spark):
    aliases = {"الاقتصاد": ["اقتصاد", "اسواق"], "السيارات": ["سيارات"]}
    rows = [(["اقتصاد"],), (["سيارات"],), (["اقتصاد", "سيارات"],), (["أخبار السعودية"],), ([],), (None,), (["other"],)]
    df = spark.createDataFrame(rows, "main array<string>").withColumn("allowed", T.source_categories(F.col("main"), aliases, "أخبار السعودية"))
    assert [r.allowed for r in df.collect()] == [["الاقتصاد"], ["السيارات"], [], [], [], [], []]
    one = df.withColumns({"title": F.lit(STORIES[0][0]), "body": F.lit(STORIES[0][1])})
    found = T.classify(one, F.col("title"), F.col("body"), POLICIES, F.col("allowed"), F.array(F.lit("الذهب"))).collect()
    assert [r.classification.category for r in found] == ["الاقتصاد", "السيارات"] + ["الاقتصاد"] * 5
    assert found[1].classification.needs_review and found[1].classification.alternatives == [] and found[0].classification.subcategory == "الذهب"


def test_compatibility_forms_fold_to_their_letters(spark):
    rows = [("ﷲ ﻻ ﺍﻟﺬﻫﺐ", "الله لا الذهب"), ("ﬁne ①２", "fine 12"), ("أَهْلًا", "اهلا"), (None, None)]
    found = spark.createDataFrame(rows, "a string, b string").select(compat.normalized(F.col("a")).alias("x"), F.col("b"), compat.normalized_title(F.col("a")).alias("t")).collect()
    assert [r.x for r in found] == [r.b for r in found]
    assert [r.t for r in found] == ["الله لا الذهب", "fine 12", "أهلا", None]


def test_only_stories_without_tags_are_read_unless_all_are_asked_for(spark):
    rows = [(1, ["kept"], STORIES[0][0]), (2, [], STORIES[0][0]), (3, None, STORIES[0][0]), (4, [" "], "nothing")]
    df = spark.createDataFrame(rows, "id int, own array<string>, title string")
    one = {r.id: r.own for r in repairs.backfilled_tags(df, "own", F.col("title"), F.lit(""), T.Dictionaries(TOPICS)).collect()}
    assert one == {1: ["kept"], 2: ["الاقتصاد والأسواق"], 3: ["الاقتصاد والأسواق"], 4: []}
    every = {r.id: r.own for r in repairs.backfilled_tags(df, "own", F.col("title"), F.lit(""), T.Dictionaries(TOPICS), everything=True).collect()}
    assert every == one | {1: ["الاقتصاد والأسواق"]}


def test_a_second_classification_moves_or_asks_for_review(spark):
    rows = [(i, t, b, "السياسة", "published", f"2024-01-0{1 + i}") for i, (t, b) in enumerate(STORIES)] + [(9, *STORIES[0], "السياسة", "draft", "2024-01-02"), (10, *STORIES[0], "السياسة", "published", "2023-01-01")]
    df = spark.createDataFrame(rows, "id int, title string, body string, filed string, status string, day string")
    window = F.struct(F.lit("2024-01-01").cast("timestamp").alias("start"), F.lit("2024-02-01").cast("timestamp").alias("end"))
    found = repairs.reclassified_pending(df, "filed", F.col("status"), F.col("day").cast("timestamp"), window, F.col("title"), F.col("body"), POLICIES)
    assert {r.id: (r.outcome, r.move) for r in found.collect()} == {0: ("reassigned", "السياسة -> الاقتصاد"), 1: ("unchanged", None), 2: ("reassigned", "السياسة -> المجتمع"), 3: ("reassigned", "السياسة -> السيارات"), 4: ("sent_to_review", None)}
