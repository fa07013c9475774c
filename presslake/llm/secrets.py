"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text. Each candidate's value is hashed, and the hashes
are counted over the corpus by distinct repositories and owners: first one row per hash, owner and
repository (combined before the shuffle, so a value that a third of all rows carries is one row per
task), then per owner, then per hash. A value of many owners, or spread over many repositories by more
than one, is a widely copied example; one that a single owner holds, in however many repositories, or
few, is live-looking. Base candidates always stay; opaque tokens, which no pattern of the base names,
become spans only where ownership says that they are live-looking.

Defined cases: a null text counts as empty and has no span; a null owner or repository is one of its
own, named ''; repeated rows give a row each, alike, and count once for ownership; a null doc_id
stays null; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.llm.common import documents
from presslake.session import checkpoint

#: Kind -> (pattern, group of the value, least characters of it), in the order of the contract; the first three are the base.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "opaque": (r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
}
BASE = ("assign", "access", "hex")
#: A row that doesn't match this has no candidate.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/_-]{24}"""
#: Owners from which on a value is a widely copied example, and repositories from which on one of two owners is.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 4


def _candidates(rows: DataFrame) -> DataFrame:
    """Row id, kind, start, end (code points) and value of every match, leftmost and non-overlapping per kind."""
    def matches(kind: str, order: int) -> Column:
        pattern, group, least = PATTERNS[kind]
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else found
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        zipped = F.arrays_zip(F.transform(found, F.length).alias("size"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), value.alias("value"))

        def one(x: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), F.lit(least).alias("least"), i.alias("i"), x["size"].alias("size"), x["gap"].alias("gap"), x["value"].alias("value"))

        return F.transform(zipped, one)

    kinds = [matches(kind, order) for order, kind in enumerate(PATTERNS)]
    each = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text_hash", "repository", "owner", F.inline(F.concat(*kinds)))
    so_far = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    opaque = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & ~F.col("value").rlike("^AKIA")
    return placed.filter((F.length("value") >= F.col("least")) & ((F.col("kind") != "opaque") | opaque)).select("doc_id", "text_hash", "repository", "owner", "kind", "kind_order", "start", "end", F.sha2("value", 256).alias("value_hash"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate value."""
    by_owner = candidates.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def find(docs: DataFrame, repository: Column, owner: Column, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Rows with candidates: doc_id, text_hash and found, an array of spans with their ownership, by start, then kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    # both written: the patterns run once, and either side of the join is a plain shuffle, which Spark can split where a value is hot
    some = checkpoint(_candidates(rows.filter(F.col("text").rlike(ANY)).withColumn("text_hash", F.xxhash64("text"))))
    judged = some.join(checkpoint(ownership(some)), "value_hash", "left").withColumn("live", (F.col("n_owners") < copied_owners) & ((F.col("n_owners") < 2) | (F.col("n_repositories") < COPIED_REPOSITORIES)))
    kept = judged.filter((F.col("kind") != "opaque") | F.col("live"))
    span = F.struct("start", "kind_order", "end", "kind", "live", "n_owners", "n_repositories", "value_hash")
    return kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("found"))


def _with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (with a column text_hash) and the spans of each row."""
    right = found.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    return docs.join(right, docs["doc_id"].eqNullSafe(right["found_id"]) & (docs["text_hash"] == right["found_hash"]), "left").drop("found_id", "found_hash")


def scan(docs: DataFrame, repository: Column, owner: Column, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Every row's spans: counts of the base kinds, all spans as text, and how many are live-looking or copied."""
    found = find(docs, repository, owner, copied_owners)
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    spans = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    joined = _with_spans(keys, found).withColumn("found", spans)
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return joined.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(text(F.filter("found", lambda s: s["kind"] != "opaque")), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        *(F.coalesce(F.array_max(F.transform("found", lambda s: s[n])), F.lit(0).cast("long")).alias(f"most_{n[2:]}") for n in ("n_owners", "n_repositories")),
    )


def mask(docs: DataFrame, repository: Column, owner: Column, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """The same rows and columns with every span of text replaced: [SECRET] where live-looking, [EXAMPLE SECRET] where widely copied.

    Only rows with candidates are shuffled. Overlapping spans are replaced as one; n_chars, if there, follows the text.
    """
    names, known = docs.columns, ("doc_id", "text", "n_chars")
    docs = docs.select(*(F.col(f"`{c}`").alias(c if c in known else f"c{i}") for i, c in enumerate(names)), repository.alias("repository"), owner.alias("owner"))
    text = F.coalesce("text", F.lit(""))
    hit = text.rlike(ANY)
    columns = docs.columns
    some = _with_spans(docs.filter(hit).withColumn("text_hash", F.xxhash64(text)), find(docs.filter(hit), F.col("repository"), F.col("owner"), copied_owners))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    label = lambda s: F.when(s["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE SECRET]"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        before = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], before, label(s))).alias("out"))

    done = F.aggregate(F.col("found"), none, step, lambda x: F.concat(x["out"], F.substring(F.col("text"), (x["at"] + 1).cast("int"), F.length("text"))))
    masked = some.withColumn("text", F.when(F.col("found").isNull(), F.col("text")).otherwise(done))
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.filter(~hit).unionByName(masked.select(*columns)).drop("repository", "owner").toDF(*names)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner; a source's documents of one language are a repository."""
    return scan(documents(spark, sf_dir), F.col("lang"), F.col("source"))


#: The contract's rules as SQL of their own; the least lengths of access and hex are in the patterns, as their runs are found whole.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
                                ('access', 1, 'AKIA[A-Z0-9]{12,}', 16), ('hex', 2, '[0-9a-f]{32,}', 32), ('opaque', 3, '[A-Za-z0-9+/_-]{24,}={0,2}', 24)) v(kind, kind_order, pattern, least)),
matches AS (
    SELECT row, doc_id, source, lang, kind, kind_order, least, f AS found, v AS vals, string_split_regex(text, pattern) AS gaps FROM (
        SELECT *, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS f, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM docs, kinds WHERE kind = 'assign'
        UNION ALL SELECT *, regexp_extract_all(text, 'AKIA[A-Z0-9]{12,}') AS f, f AS v FROM docs, kinds WHERE kind = 'access'
        UNION ALL SELECT *, regexp_extract_all(text, '[0-9a-f]{32,}') AS f, f AS v FROM docs, kinds WHERE kind = 'hex'
        UNION ALL SELECT *, regexp_extract_all(text, '[A-Za-z0-9+/_-]{24,}={0,2}') AS f, f AS v FROM docs, kinds WHERE kind = 'opaque')),
each AS (SELECT *, unnest(generate_series(1, len(found))) AS i FROM matches),
placed AS (SELECT row, doc_id, source, lang, kind, kind_order, least, vals[i] AS val, sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY row, kind ORDER BY i) AS stop, length(found[i]) AS size FROM each),
cand AS (SELECT *, CAST(stop - size AS BIGINT) AS begin_at FROM placed
         WHERE length(val) >= least AND (kind <> 'opaque' OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND NOT starts_with(val, 'AKIA')))),
owners AS (SELECT val, count(DISTINCT source) AS n_owners, count(DISTINCT (source, lang)) AS n_repositories FROM cand GROUP BY val),
judged AS (SELECT cand.*, n_owners, n_repositories, n_owners = 1 OR n_owners = 2 AND n_repositories <= 3 AS live, kind || ':' || begin_at || ':' || CAST(stop AS BIGINT) AS span FROM cand JOIN owners USING (val)),
kept AS (SELECT * FROM judged WHERE kind <> 'opaque' OR live),
per AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(span, ',' ORDER BY begin_at, kind_order) FILTER (kind <> 'opaque') AS base, string_agg(span, ',' ORDER BY begin_at, kind_order) AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM kept GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM docs LEFT JOIN per USING (row)"""
