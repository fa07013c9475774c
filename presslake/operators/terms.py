"""Dictionaries run over texts: which of many terms a text holds, and what follows from that: tags and categories (TX-25, MA-6, MA-7).

All terms of all dictionaries are one automaton, which reads a text once however many terms there are. It
goes to the workers as a broadcast of the terms, PART of them at a time: a larger dictionary is several
automata, one read each. What the hits are worth is said by DataFrame functions over small arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from presslake.functions import columns as C
from presslake.functions import policy as P
from presslake.session import ship

#: Terms of an automaton.
PART = 50_000
_automata: dict[str, object] = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of a broadcast dictionary, once a worker; the last one used is kept."""
    if key not in _automata:
        import ahocorasick

        own = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            own.add_word(term, (*own.get(term, ()), number))
        own.make_automaton()
        _automata.clear()
        _automata[key] = own
    return _automata[key]


def term_hits(df: DataFrame, fields: dict[str, str], terms: list[str], part: int = PART) -> DataFrame:
    """df with columns of ascending numbers of the ``terms`` that a text column holds as a part; fields: name of the new column -> the text column.

    Texts and terms are compared as they are. An empty term is held by none; a null text holds none; a term listed twice has two numbers.
    """
    spark = df.sparkSession
    ship(spark)
    own = [(number, term) for number, term in enumerate(terms) if term]
    for name in fields:
        if name in df.columns:
            raise ValueError(f"the table has a column {name}")
    out = df.withColumns({name: F.array().cast("array<int>") for name in fields})
    for at in range(0, len(own), part):
        numbers, words = zip(*own[at : at + part])
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, numbers, list(words)))
        schema = StructType([StructField(f.name, ArrayType(IntegerType())) if f.name in fields else f for f in out.schema])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, arrow=arrow) -> Iterator[pa.RecordBatch]:
            key, numbers, words = sent.value
            own = _automaton(key, words)
            for batch in batches:
                columns = dict(zip(batch.schema.names, batch.columns))
                for name, text in fields.items():
                    found = [sorted({numbers[n] for _, hit in own.iter(value) for n in hit}) if value else [] for value in columns[text].to_pylist()]
                    columns[name] = pa.array([a + b for a, b in zip(columns[name].to_pylist(), found)], arrow.field(name).type)
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

        out = out.mapInArrow(run, schema)
    return out


def folded(term: str) -> str:
    """A term as columns.normalized() gives it."""
    marks = {chr(c) for c in range(0x64B, 0x660)} | {chr(0x670)}
    bare = "".join(c for c in term if c not in marks).translate(str.maketrans(C.ARABIC_FROM, C.ARABIC_TO))
    return " ".join("".join(c if c.isalnum() else " " for c in bare).split()).lower()


#: Words that make no tag, and values that are too general for one (fixed values).
STOP = (
    "في من على إلى الى عن مع بعد قبل خلال لدى بين ضد دون حول عند هذا هذه ذلك التي الذي هو هي تم كما ما لا لم لن قد كل أكثر اكثر ضمن عبر حتى "
    "اليوم أمس امس جديدة جديد خبر أخبار اخبار تقرير تقارير مصدر صحيفة وكالة قناة موقع"
).split()
GENERIC = ("أخبار", "الأخبار", "خبر", "تقرير", "متابعة", "عاجل", "اليوم", "السعودية")
#: Words of a source's name that don't tell it from others (fixed values).
NOT_NAMES = ("صحيفه", "وكاله", "قناه", "اخبار", "الالكترونيه", "السعوديه")
#: Places and beginnings of names (fixed values).
PLACES = (
    "السعودية الرياض مكة جدة".split()
    + ["المدينة المنورة"]
    + "الدمام القصيم عسير تبوك جازان نجران الباحة الجوف".split()
    + ["الخليج العربي", "الشرق الأوسط"]
    + "فلسطين غزة العراق سوريا لبنان اليمن إيران تركيا روسيا أوكرانيا الصين".split()
    + ["الولايات المتحدة", "أوروبا"]
)
PREFIXES = ("وزارة", "هيئة", "جامعة", "شركة", "مجلس", "رئيس", "وزير", "ولي العهد", "خادم الحرمين", "البنك المركزي", "الأمم المتحدة")
#: Points of the kinds of tags (fixed values).
POINTS = {"category": 10, "subcategory": 11, "region": 9, "topic": 8, "place": 7, "name": 9}


@dataclass(frozen=True)
class Dictionaries:
    """topics: name -> signals, any of which gives the topic; places; beginnings of names."""

    topics: dict[str, list[str]]
    places: tuple[str, ...] = tuple(PLACES)
    prefixes: tuple[str, ...] = PREFIXES
    stop: tuple[str, ...] = tuple(STOP)
    generic: tuple[str, ...] = GENERIC
    not_names: tuple[str, ...] = NOT_NAMES


def clean(text: Column) -> Column:
    """Text without references, URLs and marks, white space joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)&\w+;|https?://\S+", " "), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))


def semantic_tags(df: DataFrame, title: Column, body: Column, own: Dictionaries, category: Column | None = None, subcategory: Column | None = None, region: Column | None = None, source: Column | None = None, domain: Column | None = None, tags: int = 8, keyphrases: int = 6) -> DataFrame:
    """df with ``tags`` and ``keyphrases`` of its texts (TX-25).

    Candidates: the category and what else is known of the text, topics any of whose signals it holds, places, and the first
    name after each beginning, five words of it at most. Those that hold a word of the source's name, are too general or
    only stop words fall out; of equal ones, once folded, the best counts. Best points first, then shorter ones, then the
    earlier one; keyphrases are topics, names and those of several words.
    """
    names = ("text_", "plain_", "hits_", "tags", "keyphrases", "known_")
    if taken := set(names) & set(df.columns):
        raise ValueError(f"the table has columns {sorted(taken)}")
    none = F.lit(None).cast("string")
    given = {"category": category, "subcategory": subcategory, "region": region}
    known = F.array(*(F.struct((none if c is None else c).alias("value"), F.lit(POINTS[n]).alias("score"), F.lit(False).alias("phrase")) for n, c in given.items()))
    words = F.concat(*(F.split(C.normalized(clean(F.regexp_replace(F.coalesce(none if c is None else c, F.lit("")), r"(?i)\.[a-z.]+$", ""))), r"[\s.-]+") for c in (source, domain)))
    blocked = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*own.not_names))
    text = clean(F.concat_ws(" ", title, body))
    base = df.withColumns({"text_": text, "known_": F.struct(known.alias("given"), blocked.alias("blocked"))})
    base = base.withColumn("plain_", C.normalized(F.col("text_")))
    signals = [(name, folded(signal)) for name, many in own.topics.items() for signal in many]
    places = [(place, folded(place)) for place in own.places]
    found = term_hits(base, {"hits_": "plain_"}, [term for _, term in signals + places])
    candidate = lambda value, points, phrase: F.struct(value.alias("value"), F.lit(points).alias("score"), F.lit(phrase).alias("phrase"))
    hit = lambda numbers: F.arrays_overlap("hits_", F.array(*map(F.lit, numbers)))
    at = {name: [i for i, (of, _) in enumerate(signals) if of == name] for name in own.topics}
    parts = [F.col("known_.given")]
    parts.append(F.array(*(candidate(F.when(hit(numbers), F.lit(name)), POINTS["topic"], True) for name, numbers in at.items() if numbers)))
    place_names = F.array(*(F.lit(place) for place, _ in places))
    is_place = F.filter("hits_", lambda i: i >= len(signals))
    parts.append(F.transform(is_place, lambda i: candidate(F.get(place_names, i - len(signals)), POINTS["place"], False)))
    name_of = lambda prefix: F.regexp_extract("text_", rf"(?:^|\s)({prefix}\s+\p{{L}}[\p{{L}}\s-]{{2,42}})", 1)
    five = lambda value: F.array_join(F.slice(F.split(value, " "), 1, 5), " ")
    parts.append(F.array(*(candidate(five(name_of(p)), POINTS["name"], True) for p in own.prefixes)))
    parts = [p for p in parts if p is not None]
    plain = F.transform(F.concat(*parts), lambda c, i: F.struct(clean(F.coalesce(c["value"], F.lit(""))).alias("value"), c["score"].alias("score"), c["phrase"].alias("phrase"), i.alias("i")))
    keyed = F.transform(plain, lambda c: F.struct(c["value"].alias("value"), c["score"].alias("score"), c["phrase"].alias("phrase"), c["i"].alias("i"), C.normalized(c["value"]).alias("key")))
    says = lambda c: (F.length(c["value"]) >= 3) & ~c["value"].isin(*own.generic) & ~F.exists("known_.blocked", lambda b: c["key"].contains(b)) & F.exists(F.split(c["key"], " "), lambda w: ~w.isin(*own.stop))
    held = found.withColumn("candidates_", F.explode(F.array(F.filter(keyed, says))))  # computed once
    better = lambda c: F.exists("candidates_", lambda o: (o["key"] == c["key"]) & ((o["score"] > c["score"]) | (o["score"] == c["score"]) & (o["i"] < c["i"])))
    first = lambda c: F.array_min(F.transform(F.filter("candidates_", lambda o: o["key"] == c["key"]), lambda o: o["i"]))
    best = F.transform(F.filter("candidates_", lambda c: ~better(c)), lambda c: F.struct((-c["score"]).alias("a"), F.length(c["value"]).alias("b"), first(c).alias("c"), c["value"].alias("value"), c["phrase"].alias("phrase")))
    ranked = held.withColumn("ranked_", F.explode(F.array(F.array_sort(best))))
    value = lambda c: c["value"]
    phrases = F.filter("ranked_", lambda c: c["phrase"] | c["value"].contains(" "))
    return ranked.select(*df.columns, F.slice(F.transform("ranked_", value), 1, tags).alias("tags"), F.slice(F.transform(phrases, value), 1, keyphrases).alias("keyphrases"))


#: Points of a rule's term in the title, and in the body where the title doesn't hold it (fixed values).
WEIGHTS = {"strong": (9.0, 4.0), "helper": (3.0, 1.5), "entity": (6.0, 2.0), "exclude": (-12.0, -5.0)}
#: What a specialised category loses without a term in the title, and the least lead over the next category (fixed values).
NOT_IN_TITLE, LEAST_MARGIN = 6.0, 2.0


@dataclass(frozen=True)
class Policy:
    """Terms of a category by role, the least points that it needs, and whether it is a specialised one."""

    strong: list[str] = field(default_factory=list)
    helper: list[str] = field(default_factory=list)
    entity: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    minimum: float = 7.0
    specialised: bool = False


def without_articles(text: Column) -> Column:
    """Every word of a folded text without the definite article."""
    return F.array_join(F.transform(F.split(text, r"\s+"), P.without_article), " ")


def source_categories(main: Column, aliases: dict[str, list[str]], general: str, most: int = 10) -> Column:
    """Categories that a source's only section stands for; none, so that any may win, for several sections, the general one, or ``most`` categories and more (MA-7)."""
    own = F.transform(F.coalesce(main, F.array().cast("array<string>")), C.normalized)
    named = F.filter(F.array(*(F.when(F.arrays_overlap(own, F.array(*(F.lit(folded(a)) for a in names))), F.lit(category)) for category, names in aliases.items() if names)), lambda c: c.isNotNull())
    free = (F.size(own) > 1) | F.array_contains(own, folded(general)) | (F.size(named) >= most)
    return F.when(free, F.array().cast("array<string>")).otherwise(named)


def classify(df: DataFrame, title: Column, body: Column, policies: dict[str, Policy], allowed: Column | None = None, subcategories: Column | None = None) -> DataFrame:
    """df with ``classification``: category, subcategory, score, margin, confidence, needs_review, reasons and up to three alternatives (MA-6).

    A term counts by its role, more in the title than in the body; it is held as it is or, with every word's article cut
    off, in the text without articles. A specialised category without a term in the title loses points. ``allowed``: the
    only categories that may win, all if empty. Of equal points the first category wins; too few points or too small a lead
    over the next one ask for review.
    """
    names = ("title_", "body_", "allowed_", "sub_", "scores_", "classification")
    if taken := {c for c in df.columns if c in names or c.startswith("hits_")}:
        raise ValueError(f"the table has columns {sorted(taken)}")
    rules = [(number, role, folded(term)) for number, policy in enumerate(policies.values()) for role in WEIGHTS for term in getattr(policy, role)]
    bare = [" ".join(w[2:] if w.startswith("ال") and len(w) > 3 else w for w in term.split()) for _, _, term in rules]
    base = df.withColumns({"title_": F.coalesce(C.normalized(title), F.lit("")), "body_": F.coalesce(C.normalized(body), F.lit(""))})
    base = base.withColumns({"allowed_": F.array().cast("array<string>") if allowed is None else F.coalesce(allowed, F.array().cast("array<string>")), "sub_": F.array().cast("array<string>") if subcategories is None else F.coalesce(subcategories, F.array().cast("array<string>"))})
    base = base.withColumns({"title_bare_": without_articles(F.col("title_")), "body_bare_": without_articles(F.col("body_"))})
    found = term_hits(base, {"hits_title": "title_", "hits_body": "body_"}, [term for _, _, term in rules])
    found = term_hits(found, {"hits_title_bare": "title_bare_", "hits_body_bare": "body_bare_"}, [term if len(term) > 2 else "" for term in bare])
    table = lambda values: F.array(*map(F.lit, values))
    category, in_title, in_body, counts = table([n for n, _, _ in rules]), table([WEIGHTS[r][0] for _, r, _ in rules]), table([WEIGHTS[r][1] for _, r, _ in rules]), table([r != "exclude" for _, r, _ in rules])
    titled = F.array_union("hits_title", "hits_title_bare")
    rest = F.array_except(F.array_union("hits_body", "hits_body_bare"), titled)
    worth = lambda hits, points, flag: F.transform(hits, lambda i: F.struct(F.get(category, i).alias("c"), F.get(points, i).alias("w"), (flag & F.get(counts, i)).alias("t")))
    held = found.withColumn("points_", F.explode(F.array(F.concat(worth(titled, in_title, F.lit(True)), worth(rest, in_body, F.lit(False))))))
    special, minimum, labels = table([p.specialised for p in policies.values()]), table([float(p.minimum) for p in policies.values()]), table(list(policies))
    mine = lambda c: F.filter("points_", lambda x: x["c"] == c)
    total = lambda c: F.aggregate(mine(c), F.lit(0.0), lambda s, x: s + x["w"])
    scored = lambda c: F.when(F.get(special, c) & ~F.exists(mine(c), lambda x: x["t"]) & (total(c) > 0), F.greatest(F.lit(0.0), total(c) - NOT_IN_TITLE)).otherwise(total(c))
    every = F.transform(F.sequence(F.lit(0), F.lit(len(policies) - 1)), lambda c: F.struct((-scored(c)).alias("minus"), c.alias("place"), F.get(labels, c).alias("category"), scored(c).alias("score"), F.get(minimum, c).alias("minimum")))
    may = lambda x: (F.size("allowed_") == 0) | F.array_contains("allowed_", x["category"])
    ranked = held.withColumn("scores_", F.explode(F.array(F.array_sort(F.filter(every, may)))))
    top = lambda i: F.get("scores_", F.lit(i))
    score, lead = F.coalesce(top(0)["score"], F.lit(0.0)), F.coalesce(top(0)["score"], F.lit(0.0)) - F.coalesce(top(1)["score"], F.lit(0.0))
    low = score < F.coalesce(top(0)["minimum"], F.lit(0.0))
    review = low | (lead < LEAST_MARGIN)
    unsure = F.greatest(F.lit(20.0), F.least(F.lit(69.0), 35 + score * 3 + F.greatest(F.lit(0.0), lead)))
    confidence = C.half_up(F.when(review, unsure).otherwise(F.least(F.lit(99.0), 68 + score * 2 + lead))).cast("int")
    matched = F.coalesce(F.get(F.filter("sub_", lambda s: F.col("body_").contains(C.normalized(s)) | F.col("title_").contains(C.normalized(s))), 0), F.lit(""))
    reasons = F.when(low, F.array(F.lit("below_category_threshold"))).when(review, F.array(F.lit("ambiguous_category"))).otherwise(F.array().cast("array<string>"))
    out = {
        "category": top(0)["category"],
        "subcategory": F.when(C.normalized(matched) == C.normalized(top(0)["category"]), "").otherwise(matched),
        "score": score,
        "margin": lead,
        "confidence": confidence,
        "needs_review": review,
        "reasons": reasons,
        "alternatives": F.transform(F.slice("scores_", 2, 3), lambda x: F.struct(x["category"].alias("category"), x["score"].alias("score"))),
    }
    return ranked.select(*df.columns, F.struct(*(c.alias(n) for n, c in out.items())).alias("classification"))
