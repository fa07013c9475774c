"""Dictionaries over whole texts of the driver's documents: tags and categories, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.operators import repairs
from presslake.operators import terms as T
from presslake.plans.catalog import ORACLE_SQL, query
from presslake.session import read

#: Dictionaries for the corpus's invented prose: endings and syllables as signals, common words as places.
TOPICS = {"Common endings": ["tion", "ments"], "Doubled sounds": ["thth", "erer"], "License texts": ["license", "copyright"], "Credentials": ["password", "api key", "secret"], "Romance words": ["pour", "elle", "ción"]}
DICTIONARIES = T.Dictionaries(TOPICS, ("Thing", "Anin", "Words", "Reand", "Northern anea"), ("The", "With", "Der"), ("the", "with", "and"), ("Common endings",), ("src",))
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
_FOLD = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '&\w+;|https?://\S+', ' ', 'gi'), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_SIGNALS = ", ".join(f"('{topic}', {n}, '{T.folded(s)}')" for n, (topic, many) in enumerate(TOPICS.items()) for s in many)
_PLACES = ", ".join(f"({n}, '{p}', '{T.folded(p)}')" for n, p in enumerate(DICTIONARIES.places))
_PREFIXES = ", ".join(f"({n}, '{p}')" for n, p in enumerate(DICTIONARIES.prefixes))
_NAME = "CASE " + " ".join(f"WHEN p.n = {n} THEN regexp_extract(t.text, '(?:^|\\s)({p}\\s+\\p{{L}}[\\p{{L}}\\s-]{{2,42}})', 1)" for n, p in enumerate(DICTIONARIES.prefixes)) + " END"


@query(
    "semantic_tags",
    rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, regexp_extract(coalesce(text, ''), '^[^.]*') AS title FROM documents),
        t AS (SELECT doc_id, lang, source, {_CLEAN.format("title || ' ' || text")} AS text FROM d),
        p AS (SELECT *, {_FOLD.format("text")} AS plain FROM t),
        s AS (SELECT * FROM (VALUES {_SIGNALS}) v(topic, n, signal)), l AS (SELECT * FROM (VALUES {_PLACES}) v(n, place, term)), b AS (SELECT * FROM (VALUES {_PREFIXES}) v(n, prefix)),
        c AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS value, 10 AS score, false AS phrase, 0 AS i FROM p
              UNION ALL SELECT DISTINCT doc_id, source, topic, 8, true, 100 + n FROM p JOIN s ON contains(plain, signal)
              UNION ALL SELECT doc_id, source, place, 7, false, 200 + n FROM p JOIN l ON contains(plain, term)
              UNION ALL SELECT t.doc_id, t.source, array_to_string(string_split({_NAME}, ' ')[1:5], ' '), 9, true, 300 + p.n FROM t, b AS p),
        k AS (SELECT *, {_FOLD.format("value")} AS key FROM (SELECT doc_id, source, {_CLEAN.format("value")} AS value, score, phrase, i FROM c WHERE value IS NOT NULL)),
        v AS (SELECT * FROM k WHERE len(value) >= 3 AND value <> 'Common endings' AND NOT (len(source) >= 3 AND contains(key, lower(source))) AND len(list_filter(string_split(key, ' '), lambda w: w NOT IN ('the', 'with', 'and'))) > 0),
        u AS (SELECT *, min(i) OVER (PARTITION BY doc_id, key) AS first FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY score DESC, i) = 1),
        g AS (SELECT doc_id, list(value ORDER BY score DESC, len(value), first)[1:8] AS tags, (list(value ORDER BY score DESC, len(value), first) FILTER (phrase OR contains(value, ' ')))[1:6] AS phrases FROM u GROUP BY doc_id)
        SELECT doc_id, coalesce(array_to_string(tags, '|'), '') AS tags, coalesce(array_to_string(phrases, '|'), '') AS keyphrases FROM d LEFT JOIN g USING (doc_id)""",
)
def semantic_tags(spark, sf_dir):
    """TX-25 over whole texts; a text's first sentence is its title."""
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[F.coalesce("lang", F.lit(""))]
    found = T.semantic_tags(docs, F.regexp_extract(text, "^[^.]*", 0), text, DICTIONARIES, category=language, source=F.col("source"))
    return found.select("doc_id", F.array_join("tags", "|").alias("tags"), F.array_join("keyphrases", "|").alias("keyphrases"))


POLICIES = {
    "English": T.Policy(strong=["that", "with this"], helper=["from", "the ", "and"], entity=["only"], exclude=["pour", "der "]),
    "French": T.Policy(strong=["pour", "dans"], helper=["les", "que", "une"], entity=["elle"], exclude=["with", "that"]),
    "German": T.Policy(strong=["nicht", "eine"], helper=["der", "und", "ein"], entity=["auch"], exclude=["with"], minimum=9),
    "Legal": T.Policy(strong=["license", "copyright", "warranty"], helper=["rights", "terms"], exclude=["password"], minimum=9, specialised=True),
}
_RULES = ", ".join(f"({n}, '{role}', '{T.folded(term)}', {T.WEIGHTS[role][0]}, {T.WEIGHTS[role][1]})" for n, policy in enumerate(POLICIES.values()) for role in T.WEIGHTS for term in getattr(policy, role))
_POLICIES = ", ".join(f"({n}, '{name}', {p.minimum}, {str(p.specialised).lower()})" for n, (name, p) in enumerate(POLICIES.items()))


@query(
    "classified_articles",
    rf"""WITH d AS (SELECT doc_id, {_FOLD.format("regexp_extract(coalesce(text, ''), '^[^.]*')")} AS title, {_FOLD.format("coalesce(text, '')")} AS body FROM documents),
        r AS (SELECT * FROM (VALUES {_RULES}) v(n, role, term, high, low)), p AS (SELECT * FROM (VALUES {_POLICIES}) v(n, category, minimum, special)),
        h AS (SELECT doc_id, n, sum(CASE WHEN contains(title, term) THEN high WHEN contains(body, term) THEN low ELSE 0 END) AS score, bool_or(role <> 'exclude' AND contains(title, term)) AS titled FROM d, r GROUP BY doc_id, n),
        s AS (SELECT doc_id, n, category, minimum, CAST(CASE WHEN special AND NOT titled AND score > 0 THEN greatest(0, score - 6) ELSE score END AS DOUBLE) AS score FROM h JOIN p USING (n)),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS place FROM s),
        w AS (SELECT doc_id, max(category) FILTER (place = 1) AS category, max(score) FILTER (place = 1) AS score, max(minimum) FILTER (place = 1) AS minimum, max(score) FILTER (place = 1) - max(score) FILTER (place = 2) AS margin,
                     string_agg(category || ':' || CAST(score AS VARCHAR), '|' ORDER BY place) FILTER (place BETWEEN 2 AND 4) AS alternatives FROM o GROUP BY doc_id)
        SELECT doc_id, category, score, margin, score < minimum OR margin < 2 AS needs_review,
               CAST(floor(CASE WHEN score < minimum OR margin < 2 THEN greatest(20.0, least(69.0, 35 + score * 3 + greatest(0.0, margin))) ELSE least(99.0, 68 + score * 2 + margin) END + 0.5) AS INTEGER) AS confidence,
               CASE WHEN score < minimum THEN 'below_category_threshold' WHEN margin < 2 THEN 'ambiguous_category' ELSE '' END AS reasons, alternatives FROM w""",
)
def classified_articles(spark, sf_dir):
    """MA-6 over whole texts; a text's first sentence is its title."""
    text = F.coalesce("text", F.lit(""))
    found = T.classify(read(spark, sf_dir, "documents"), F.regexp_extract(text, "^[^.]*", 0), text, POLICIES)
    c = F.col("classification")
    alternatives = F.array_join(F.transform(c["alternatives"], lambda x: F.concat(x["category"], F.lit(":"), x["score"].cast("string"))), "|")
    return found.select("doc_id", c["category"].alias("category"), c["score"].alias("score"), c["margin"].alias("margin"), c["needs_review"].alias("needs_review"), c["confidence"].alias("confidence"), F.array_join(c["reasons"], "|").alias("reasons"), alternatives.alias("alternatives"))


@query(
    "backfilled_tags",
    rf"""WITH s AS ({ORACLE_SQL["semantic_tags"]}), h AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '#([\p{{L}}\p{{N}}_]+)', 1))) AS own FROM documents)
        SELECT doc_id, CASE WHEN len(own) > 0 THEN array_to_string(own, '|') ELSE tags END AS tags FROM h JOIN s USING (doc_id)""",
)
def backfilled_tags(spark, sf_dir):
    """BJ-1: documents keep the hashtags of their texts; those without any get semantic tags."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").withColumn("own", F.array_sort(C.hashtags(text)))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[F.coalesce("lang", F.lit(""))]
    found = repairs.backfilled_tags(docs, "own", F.regexp_extract(text, "^[^.]*", 0), text, DICTIONARIES, category=language, source=F.col("source"))
    return found.select("doc_id", F.array_join("own", "|").alias("tags"))


@query(
    "reclassified_documents",
    rf"""WITH c AS ({ORACLE_SQL["classified_articles"]}), d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Legal' END AS old FROM documents),
        o AS (SELECT old, category, CASE WHEN needs_review THEN 'sent_to_review' WHEN category = old THEN 'unchanged' ELSE 'reassigned' END AS outcome FROM c JOIN d USING (doc_id))
        SELECT outcome, CASE WHEN outcome = 'reassigned' THEN old || ' -> ' || category END AS move, count(*) AS n FROM o GROUP BY ALL""",
)
def reclassified_documents(spark, sf_dir):
    """BJ-8, BJ-10, AG-16: documents filed by their language, and where the rules would file them."""
    text = F.coalesce("text", F.lit(""))
    old = F.create_map(*(F.lit(x) for pair in {"en": "English", "de": "German", "fr": "French"}.items() for x in pair))[F.coalesce("lang", F.lit(""))]
    docs = read(spark, sf_dir, "documents").withColumn("filed", F.coalesce(old, F.lit("Legal")))
    always = F.struct(F.lit("2000-01-01").cast("timestamp").alias("start"), F.lit("2100-01-01").cast("timestamp").alias("end"))
    found = repairs.reclassified_pending(docs, "filed", F.lit("published"), F.lit("2024-01-01").cast("timestamp"), always, F.regexp_extract(text, "^[^.]*", 0), text, POLICIES)
    return found.groupBy("outcome", "move").agg(F.count("*").alias("n"))
