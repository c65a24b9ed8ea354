"""Registered queries over the driver's tables, each with SQL that must give the same rows.

``documents`` stand for a corpus (lang as task), ``labels`` for reviews (approved: quality 1 and not
toxic), ``benchmark`` for a gold set, and adjacent user and assistant turns for prompt and reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import metrics, rewards
from millrace.functions import text as T
from millrace.operators import convo, curriculum, evals, packing, prefs, quality, retrieval, review, sampling, templates, vocabulary
from millrace.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return convo.adjacent_pairs(table(spark, d, "conversations"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each pair with the reference of the next pair as a synthetic output, and its own without commas as another."""
    p = pairs(spark, d)
    w = Window.partitionBy(F.pmod("pair_id", F.lit(16))).orderBy("pair_id")
    return p.withColumns({"candidate": F.coalesce(F.lead("reference").over(w), F.lit("")), "baseline": F.replace("reference", F.lit(","), F.lit("")), "task": F.when(F.col("pair_id") % 2 == 0, "c2m").otherwise("m2c")})


WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _nows(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g')"


def _core(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}_]', '', 'g')"


def _audit(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '[^\x{{3400}}-\x{{9fff}}A-Za-z0-9]', '', 'g'))"


PAIRS = """p AS (SELECT conv_id * 1000 + turn AS pair_id, conv_id, text AS prompt, reference FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations)
  WHERE role = 'user' AND r2 = 'assistant')"""
CANDIDATES = (
    PAIRS
    + """, c AS (SELECT *, coalesce(lead(reference) OVER (PARTITION BY pair_id % 16 ORDER BY pair_id), '') AS candidate,
  replace(reference, ',', '') AS baseline, CASE WHEN pair_id % 2 = 0 THEN 'c2m' ELSE 'm2c' END AS task FROM p)"""
)


def _f1(name: str, out: str, ref: str) -> str:
    """CTEs: multiset F1 of characters per pair as <name>(pair_id, f1)."""
    side = lambda a, c: f"{name}_{a} AS (SELECT pair_id, e, count(*) AS n FROM (SELECT pair_id, unnest(string_split({_nows(c)}, '')) AS e FROM c WHERE {_nows(c)} <> '') GROUP BY ALL)"
    return f"""{side("o", out)}, {side("r", ref)},
  {name} AS (SELECT c.pair_id, CASE WHEN coalesce(m, 0) > 0 THEN 2 * m / (length({_nows(out)}) + length({_nows(ref)}))::DOUBLE ELSE 0.0 END AS f1
    FROM c LEFT JOIN (SELECT o.pair_id, sum(least(o.n, r.n)) AS m FROM {name}_o o JOIN {name}_r r USING (pair_id, e) GROUP BY 1) USING (pair_id))"""


@query(f"""SELECT lang, CASE WHEN t = '' THEN 'missing_text' WHEN length(t) < 200 THEN 'input_too_short' WHEN length(t) > 5000 THEN 'input_too_long' ELSE 'accepted' END AS reason, count(*) AS n
FROM (SELECT lang, {_strip("coalesce(text, '')")} AS t FROM documents) GROUP BY ALL""")
def clean_reason_counts(spark, d):
    rows = table(spark, d, "documents").select("lang", "text")
    reason = quality.clean_reason(F.lit("c2m"), F.col("text"), F.lit("x"), F.lit(None), 200, 5000)
    return rows.groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, a AS (SELECT pair_id, prompt, reference, {_audit("prompt")} AS x, {_audit("reference")} AS y FROM p),
f AS (SELECT pair_id, unnest([
  CASE WHEN x <> '' AND x = y THEN 'identical_input_output' END,
  CASE WHEN length(y) < 2 THEN 'output_too_short' END,
  CASE WHEN length(x) >= 8 AND (length(y) / length(x)::DOUBLE < 0.2 OR length(y) / length(x)::DOUBLE > 4) THEN 'extreme_length_ratio' END,
  CASE WHEN len(regexp_extract_all(reference, '[\\x{{3400}}-\\x{{9fff}}]')) < 2 THEN 'low_cjk_output' END,
  CASE WHEN len(regexp_extract_all(prompt, '\\p{{Nd}}+')) > 0 AND NOT list_has_any(regexp_extract_all(prompt, '\\p{{Nd}}+'), regexp_extract_all(reference, '\\p{{Nd}}+')) THEN 'number_or_date_mismatch' END]) AS flag FROM a)
SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY flag""")
def audit_flags_long(spark, d):
    p = pairs(spark, d).withColumn("flags", quality.audit_flags(F.lit("c2m"), F.col("prompt"), F.col("reference")))
    return review.each_flag(p, "flags")


@query("""WITH d AS (SELECT lang, (length(text) < 200 OR length(text) > 5000) AS bad FROM documents)
SELECT lang, count(*) AS n, count(CASE WHEN bad THEN 1 END) AS flagged, round(count(CASE WHEN bad THEN 1 END) / count(*)::DOUBLE, 6) AS rate FROM d GROUP BY GROUPING SETS ((), (lang))""")
def audit_flag_rates(spark, d):
    n = F.length("text")
    flags = F.array_compact(F.array(F.when(n < 200, F.lit("short")), F.when(n > 5000, F.lit("long"))))
    return quality.flag_rates(table(spark, d, "documents").select("lang", flags.alias("flags")), "lang", "flags")


@query(f"""WITH {PAIRS}, k AS (SELECT pair_id, {_audit("prompt")} AS a, {_audit("reference")} AS b FROM p),
g AS (SELECT a, min(b) <> max(b) AS conflicting FROM k GROUP BY a) SELECT pair_id, conflicting FROM k JOIN g USING (a)""")
def conflicting_prompts(spark, d):
    return quality.conflicting(pairs(spark, d), "prompt", "reference").select("pair_id", "conflicting")


@query("""SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def exact_dedup_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"))  # texts never meet in one task
    return rows.join(first, ["h", "doc_id"], "left_semi").select("doc_id", "text")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || lang || ':' || doc_id)) AS rn FROM documents)
WHERE rn <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 1000000 WHEN 'de' THEN 20 ELSE 0 END""")
def hash_sample_per_task(spark, d):
    key = T.hash_key("42", F.col("lang"), F.col("doc_id").cast("string"))
    return sampling.ranked_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", key, {"en": 50, "fr": -1, "de": 20})


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || source || ':' || doc_id)) AS rn FROM documents) WHERE rn <= 3""")
def capped_order_kept(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    return sampling.capped(rows, "source", 3, "7", F.col("source"), F.col("doc_id").cast("string")).orderBy("doc_id")


@query("""WITH a AS (SELECT doc_id, lang, source, length(text) AS len, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('9:' || lang || ':' || source || ':' || doc_id), doc_id) AS t FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY t, sha256('9:' || lang || ':' || source), source) AS pick FROM a WHERE len >= 100)
SELECT doc_id, lang, source, pick FROM b WHERE pick <= 25""")
def source_round_robin(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").alias("len"))
    return sampling.round_robin(rows, "lang", "source", "doc_id", 25, "9", F.col("len") >= 100).select("doc_id", "lang", "source", F.col("pick").cast("long").alias("pick"))


@query("""WITH f AS (SELECT doc_id, lang, length(text) > 3000 AS a, length(text) % 2 = 0 AS b FROM documents),
x AS (SELECT doc_id, lang, 'long' AS picked_for FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:long:' || doc_id), doc_id) AS rn FROM f WHERE a) WHERE rn <= 10),
y AS (SELECT doc_id, lang, 'even' AS picked_for FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:even:' || doc_id), doc_id) AS rn FROM f WHERE b AND doc_id NOT IN (SELECT doc_id FROM x)) WHERE rn <= 10)
SELECT * FROM x UNION ALL SELECT * FROM y""")
def stratified_no_replacement(spark, d):
    n = F.length("text")
    flags = F.array_compact(F.array(F.when(n > 3000, F.lit("long")), F.when(n % 2 == 0, F.lit("even"))))
    rows = table(spark, d, "documents").select("doc_id", "lang", flags.alias("flags"))
    return sampling.stratified(rows, "lang", "flags", "doc_id", ["long", "even"], 10, "5").select("doc_id", "lang", "picked_for")


_POINT = "(('0x' || substr(sha256('42:' || source), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@query(f"""SELECT doc_id, source, CASE WHEN {_POINT} < 0.6 THEN 'train' WHEN {_POINT} < 0.8 THEN 'validation' ELSE 'test' END AS split FROM documents""")
def source_hash_split(spark, d):
    return sampling.source_split(table(spark, d, "documents").select("doc_id", "source"), "source", (0.6, 0.2, 0.2), "42").select("doc_id", "source", "split")


@query(f"""WITH s AS (SELECT source, text, CASE WHEN {_POINT} < 0.6 THEN 'train' ELSE 'test' END AS split FROM documents)
SELECT 'source' AS key_kind, count(*) AS overlaps FROM (SELECT source FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'signature', count(*) FROM (SELECT {_core("text")} AS g FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)""")
def split_isolation_report(spark, d):
    rows = table(spark, d, "documents").select("source", F.sha2(T.content_core(F.col("text")), 256).alias("signature"))
    split = sampling.source_split(rows, "source", (0.6, 0.0, 0.4), "42")
    return curriculum.isolation_report(split, "split", ["source", "signature"])


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1),
g AS (SELECT DISTINCT prompt FROM f), n AS (SELECT count(*) AS n FROM g),
r AS (SELECT prompt, row_number() OVER (ORDER BY sha256('11:' || prompt), prompt) AS rn FROM g)
SELECT conv_id, CASE WHEN rn <= greatest(1, least(n - 1, round_even(n * 0.1, 0))) THEN 'validation' ELSE 'train' END AS split FROM f JOIN r USING (prompt), n""")
def prompt_group_split(spark, d):
    firsts = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return sampling.group_split(firsts, F.col("prompt"), 0.1, "11").select("conv_id", "split")


def _reviews(spark, d):
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(ok, "approved").otherwise("rejected").alias("review_status"), F.when(ok & (F.col("doc_id") % 2 == 0), F.lit("fixed")).otherwise(F.lit("")).alias("approved_reference"))


@query("""SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN NOT (quality = 1 AND toxic = 0) THEN 'removed' WHEN d.doc_id % 2 = 0 THEN 'corrected' ELSE 'confirmed' END AS review_action,
CASE WHEN l.doc_id IS NOT NULL AND quality = 1 AND toxic = 0 AND d.doc_id % 2 = 0 THEN 'fixed' ELSE md5(d.text) END AS answer FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_apply(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), convo.from_qa(F.lit("q"), F.md5("text")).alias("conversations"))
    return review.apply_reviews(docs, _reviews(spark, d)).select("id", "review_action", convo.last_of(F.col("conversations"), convo.ASSISTANT).alias("answer"))


@query("""SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' ELSE 'rejected' END AS review_status, count(*) AS n, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def review_summary(spark, d):
    j = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source").join(_reviews(spark, d), "id")
    return j.groupBy("lang", "review_status").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""SELECT doc_id AS id FROM documents WHERE length(text) > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""")
def finalize_removed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("len"))
    return review.finalized(docs, docs.where("len > 3000"), _reviews(spark, d).where("review_status = 'approved'"))[1].select("id")


@query(f"""SELECT doc_id FROM documents WHERE {_core("text")} IN (SELECT {_core("text")} FROM benchmark UNION ALL SELECT {_core("text")} FROM documents WHERE doc_id % 50 = 0)""")
def gold_leakage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    gold = table(spark, d, "benchmark").select("text").unionAll(docs.where("doc_id % 50 = 0").select("text"))
    return curriculum.leaked(docs, gold, "text", "text").select("doc_id")


@query(f"""WITH {CANDIDATES}, {_f1("f", "candidate", "reference")} SELECT pair_id, f1 AS char_f1 FROM f""")
def char_f1_pairs(spark, d):
    return metrics.char_scores(candidates(spark, d), "pair_id", "candidate", "reference").select("pair_id", "char_f1")


@query(f"""WITH {CANDIDATES}, {_f1("f", "candidate", "reference")} SELECT task, count(*) AS n, round(avg(f1), 6) AS char_f1 FROM c JOIN f USING (pair_id) GROUP BY GROUPING SETS ((), (task))""")
def eval_by_task(spark, d):
    c = candidates(spark, d)
    return evals.task_means(c.select("pair_id", "task").join(metrics.char_scores(c, "pair_id", "candidate", "reference"), "pair_id"), "task", "char_f1")


@query(f"""WITH {CANDIDATES}, {_f1("f", "candidate", "reference")}, {_f1("g", "baseline", "reference")},
o AS (SELECT task, f.f1 - g.f1 AS delta FROM c JOIN f USING (pair_id) JOIN g USING (pair_id))
SELECT task, count(*) AS n, count(CASE WHEN delta > 1e-12 THEN 1 END) AS wins, count(CASE WHEN abs(delta) <= 1e-12 THEN 1 END) AS ties, count(CASE WHEN delta < -1e-12 THEN 1 END) AS losses, round(avg(delta), 6) AS mean_delta FROM o GROUP BY GROUPING SETS ((), (task))""")
def ab_compare(spark, d):
    c = candidates(spark, d)
    score = lambda x, name: metrics.char_scores(c, "pair_id", x, "reference").select("pair_id", F.col("char_f1").alias(name))
    j = c.select("pair_id", "task").join(score("candidate", "a"), "pair_id").join(score("baseline", "b"), "pair_id")
    return evals.outcomes(evals.compared(j, "b", "a"), "task")


def _bounds(typed: bool) -> str:
    key = "i || '|' || ch" if typed else "i::VARCHAR"
    side = lambda a, col: f"""{a}0 AS (SELECT pair_id, unnest(string_split({_nows(col)}, '')) AS ch, generate_subscripts(string_split({_nows(col)}, ''), 1) AS k FROM c),
  {a}1 AS (SELECT pair_id, ch, sum(CASE WHEN regexp_matches(ch, '[\\p{{L}}\\p{{N}}_]') THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY k) AS i FROM {a}0),
  {a} AS (SELECT pair_id, {key} AS e, count(*) AS n FROM {a}1 WHERE ch <> '' AND contains('{T.MARKS}', ch) GROUP BY ALL)"""  # noqa: E731
    return f"""WITH {CANDIDATES}, {side("x", "baseline")}, {side("y", "reference")},
m AS (SELECT x.pair_id, sum(least(x.n, y.n)) AS o FROM x JOIN y USING (pair_id, e) GROUP BY 1), nx AS (SELECT pair_id, sum(n) AS n FROM x GROUP BY 1), ny AS (SELECT pair_id, sum(n) AS n FROM y GROUP BY 1)
SELECT pair_id, CASE WHEN coalesce(o, 0) > 0 THEN 2 * o / (nx.n + ny.n)::DOUBLE ELSE 0.0 END AS {"boundary" if typed else "position"}_f1 FROM c LEFT JOIN m USING (pair_id) LEFT JOIN nx USING (pair_id) LEFT JOIN ny USING (pair_id)"""


@query(_bounds(True))
def boundary_f1(spark, d):
    return metrics.boundary_scores(candidates(spark, d), "pair_id", "baseline", "reference").select("pair_id", "boundary_f1")


@query(_bounds(False))
def position_f1(spark, d):
    return metrics.boundary_scores(candidates(spark, d), "pair_id", "baseline", "reference", typed=False).select("pair_id", "position_f1")


def _triage(spark, d):
    c = candidates(spark, d)
    c = c.join(metrics.char_scores(c, "pair_id", "candidate", "reference").select("pair_id", "char_f1"), "pair_id")
    return c.withColumn("flags", evals.triage_flags(F.col("task"), F.col("prompt"), F.col("candidate"), F.col("reference"), F.col("char_f1")))


def _num(x: str) -> str:
    return f"regexp_extract_all({x}, '{T.TRIAGE_NUMBER}')"


_TRIAGE = f"""WITH {CANDIDATES}, {_f1("f", "candidate", "reference")},
t AS (SELECT pair_id, f1, length({_nows("candidate")}) / greatest(length({_nows("reference")}), 1)::DOUBLE AS ratio, list_filter([
  CASE WHEN {_nows("candidate")} = '' THEN 'empty_output' END,
  CASE WHEN {_core("prompt")} <> '' AND {_core("prompt")} = {_core("candidate")} THEN 'source_echo' END,
  CASE WHEN ratio < 0.65 THEN 'omission_risk' END, CASE WHEN ratio > 1.55 THEN 'over_translation_risk' END,
  CASE WHEN f1 < 0.4 THEN 'low_reference_overlap' END,
  CASE WHEN len({_num("reference")}) > 0 AND {_num("candidate")} <> {_num("reference")} THEN 'number_or_date_mismatch_risk' END], lambda x: x IS NOT NULL) AS flags FROM c JOIN f USING (pair_id))"""


@query(_TRIAGE + " SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM t) GROUP BY 1")
def triage_flags(spark, d):
    return review.each_flag(_triage(spark, d), "flags")


@query(_TRIAGE + """ SELECT pair_id, row_number() OVER (ORDER BY score DESC, pair_id) AS review_rank FROM (
  SELECT pair_id, round(CASE WHEN list_contains(flags, 'source_echo') THEN 3.0 ELSE 0 END + CASE WHEN list_contains(flags, 'omission_risk') THEN 2.0 ELSE 0 END + CASE WHEN list_contains(flags, 'low_reference_overlap') THEN 1.5 ELSE 0 END + CASE WHEN list_contains(flags, 'number_or_date_mismatch_risk') THEN 1.0 ELSE 0 END + CASE WHEN len(flags) > 0 THEN 0.5 ELSE 0 END, 6) AS score FROM t)
ORDER BY score DESC, pair_id LIMIT 40""")
def review_queue_topk(spark, d):
    t = _triage(spark, d)
    t = t.withColumns({"delta": F.lit(0.0), "priority": F.round(evals.triage_priority(F.lit(0.0), F.col("flags"), F.array().cast("array<string>")), 6)})
    return evals.review_queue(t, 40, ordinal="pair_id").select("pair_id", F.col("review_rank").cast("long").alias("review_rank"))


@query(f"""WITH {CANDIDATES}, u AS (SELECT pair_id, prompt, reference, task, 0 AS pos, candidate AS cand FROM c UNION ALL SELECT pair_id, prompt, reference, task, 1, baseline FROM c),
r AS (SELECT *, length({_nows("cand")}) / greatest(length({_nows("reference")}), 1)::DOUBLE AS ratio FROM u),
s AS (SELECT pair_id, pos, abs(1 - least(ratio, 2.0)) + CASE WHEN {_nows("cand")} = '' THEN 2.0 ELSE 0 END + CASE WHEN ratio < 0.3 OR ratio > 2.75 OR (task = 'c2m' AND {_core("prompt")} <> '' AND {_core("prompt")} = {_core("cand")}) THEN 1.0 ELSE 0 END AS pr FROM r)
SELECT pair_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(pr, 6) DESC, pos) AS rn FROM s) WHERE rn = 1""")
def candidate_select(spark, d):
    c = candidates(spark, d)
    u = c.select("pair_id", "prompt", "reference", "task", F.posexplode(F.array("candidate", "baseline")).alias("pos", "cand"))
    auto, flags = prefs.candidate_reasons(F.col("task"), F.col("prompt"), F.col("cand"), F.col("reference"), repetition=False)
    rated = u.withColumn("priority", prefs.candidate_priority(F.lit(1.0), T.length_ratio(F.col("cand"), F.col("reference")), F.lit(False), auto, flags))
    return prefs.best_candidate(rated, "pair_id").select("pair_id", "pos")


_LATIN = curriculum.Patterns(r"\p{Nd}+", "not|pas", "and|und", r"[A-Z][a-z]+ [A-Z]", "[,;:.!?]")


@query(f"""WITH s AS (SELECT doc_id, source, x, greatest(length({_nows("x")}), 1) AS n FROM (SELECT doc_id, source, coalesce(text, '') AS x FROM documents)),
t AS (SELECT doc_id, source, CASE WHEN n >= 80 THEN 4 WHEN n >= 40 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '[0-9]+') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, 'not|pas') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(x, 'and|und') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '[A-Z][a-z]+ [A-Z]') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(x, '[,;:.!?]')) >= 4 THEN 2 ELSE 0 END AS score FROM s)
SELECT doc_id, score::INTEGER AS score, 'hard' AS bucket FROM (SELECT * FROM t ORDER BY score DESC, sha256('3' || chr(0) || 'c2m-hard' || chr(0) || doc_id || chr(0) || coalesce(source, '')) LIMIT 60)""")
def difficulty_rank(spark, d):
    x = F.coalesce("text", F.lit(""))
    score, _ = curriculum.difficulty(x, F.lit(""), _LATIN)
    rows = table(spark, d, "documents").select("doc_id", "source", score.alias("score"))
    return curriculum.hard_and_replay(rows, "score", "doc_id", "source", 60, 0, 3).drop("source")


@query("""SELECT lang, count(*) AS n, min(length(text)) AS least, percentile_disc(0.5) WITHIN GROUP (ORDER BY length(text)) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY length(text)) AS p95,
percentile_disc(0.99) WITHIN GROUP (ORDER BY length(text)) AS p99, max(length(text)) AS most, count(CASE WHEN length(text) > 5000 THEN 1 END) AS "over" FROM documents GROUP BY lang""")
def length_percentiles(spark, d):
    return evals.length_summary(table(spark, d, "documents"), "lang", F.length("text"), 5000)


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS n_messages FROM conversations c
QUALIFY role = 'assistant' AND count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) > 0""")
def convo_prefixes(spark, d):
    c = convo.collected(table(spark, d, "conversations"))
    return convo.prefixes(c, "conv_id", "messages").select("conv_id", F.size("prefix").cast("long").alias("n_messages"))


@query("""WITH s AS (SELECT *, coalesce(count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, max(turn) FILTER (role = 'assistant') AS turn, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS user_text, max(text) FILTER (role = 'assistant') AS assistant_text
FROM s GROUP BY conv_id, i HAVING count(CASE WHEN role = 'user' THEN 1 END) > 0 AND count(CASE WHEN role = 'assistant' THEN 1 END) > 0""")
def convo_turn_pairs(spark, d):
    return convo.turn_pairs(table(spark, d, "conversations"))


@query("""SELECT conv_id, (rn - 1)::INTEGER AS pos, text AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE role = 'user'""")
def rloo_prompts(spark, d):
    return convo.user_prompts(convo.collected(table(spark, d, "conversations")), "conv_id", "messages")


@query("""SELECT conv_id, count(CASE WHEN role NOT IN ('system', 'user', 'assistant') OR text IS NULL THEN 1 END) = 0 AS valid, count(CASE WHEN role = 'system' THEN 1 END) <= 1 AND count(CASE WHEN role = 'user' THEN 1 END) = 1 AND count(CASE WHEN role = 'assistant' THEN 1 END) = 1 AND count(CASE WHEN role = 'system' THEN 1 END) = 1 AS single FROM conversations GROUP BY conv_id""")
def sharegpt_validate(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")])
    c = convo.collected(table(spark, d, "conversations")).withColumn("conv", F.transform("messages", lambda m: F.struct(names[m["role"]].alias("from"), m["content"].alias("value"))))
    return c.select("conv_id", quality.valid_conversation(F.col("conv")).alias("valid"), convo.shape_error(F.col("conv")).isNull().alias("single"))


@query("""SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels""")
def schema_aligned_union(spark, d):
    return files.aligned_union(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"))


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def set_ops(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.join(b, "doc_id", "left_anti").distinct(), "unlabelled"))


#: The rule for texts without Chinese characters (the tables hold none): g is the size of all sentences of a document up to
#: the k-th, with the blanks before it; a chunk from k on ends before the first sentence that does not fit.
@query(f"""WITH RECURSIVE t AS (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS t FROM documents),
s AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM t), u AS (SELECT doc_id, k, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM s WHERE x <> '' OR k > 1),
b AS (SELECT doc_id, k, upto + k AS g, upto - length(x) + k + 251 AS bound FROM u),
n AS (SELECT a.doc_id, a.k, greatest(min(b.k), a.k + 1) AS nxt FROM b a JOIN b ON a.doc_id = b.doc_id AND a.bound < b.g GROUP BY a.doc_id, a.k, a.bound),
c AS (SELECT doc_id, min(k) AS k, 0 AS chunk_no FROM u GROUP BY doc_id UNION ALL SELECT c.doc_id, n.nxt, c.chunk_no + 1 FROM c JOIN n ON n.doc_id = c.doc_id AND n.k = c.k JOIN u ON u.doc_id = c.doc_id AND u.k = n.nxt),
e AS (SELECT doc_id, chunk_no, k, lead(k) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS z FROM c),
x AS (SELECT e.doc_id, chunk_no, string_agg(u.x, ' ' ORDER BY u.k) AS chunk FROM e JOIN u ON u.doc_id = e.doc_id AND u.k >= e.k AND (e.z IS NULL OR u.k < e.z) GROUP BY ALL),
y AS (SELECT *, lead(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS follower FROM x WHERE chunk <> '')
SELECT doc_id, chunk_no::INTEGER AS chunk_no, CASE WHEN follower IS NULL THEN chunk ELSE {_strip("chunk || ' ' || left(follower, 50)")} END AS chunk FROM y""")
def chunk_documents(spark, d):
    return retrieval.chunked(table(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</?(?:{retrieval.BLOCK_TAGS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM b),
l AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda t: trim(regexp_replace(t, '{WS}+', ' ', 'g'))), lambda t: t <> '') AS l FROM c)
SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS line_no, unnest(l) AS line FROM l""")
def html_to_text_lines(spark, d):
    return retrieval.html_lines(table(spark, d, "pages"), "page_id", "html")


@query("""WITH s AS (SELECT a.vec_id, b.vec_id AS match_vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-12), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT vec_id, match_vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match_vec_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", 10)


@query("""WITH w AS (SELECT source, doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM (SELECT source, doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM documents)),
p AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM w)
SELECT source, (pos // 512) AS block_no, count(*) AS n, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM p WHERE total < 512 OR pos < (total // 512) * 512 GROUP BY 1, 2""")
def pack_blocks(spark, d):
    tokens = F.array_remove(F.split("text", r"[ \t\n\r]+"), "")
    return packing.packed(table(spark, d, "documents"), "source", "doc_id", tokens, 512).select("source", "block_no", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""WITH {CANDIDATES} SELECT pair_id, CASE WHEN {_core("baseline")} = {_core("reference")} THEN 1.0 ELSE -1.0 END AS guard,
CASE WHEN {_nows("baseline")} = {_nows("reference")} THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN {_strip("baseline")} <> '' AND NOT regexp_matches(baseline, '<think>|<answer>|```|答案：|解释：') THEN 1.0 ELSE 0.0 END AS direct FROM c""")
def reward_v2(spark, d):
    c = candidates(spark, d)
    o, r = F.col("baseline"), F.col("reference")
    return c.select("pair_id", rewards.preservation_guard(o, r).alias("guard"), rewards.exact(o, r).alias("exact"), rewards.direct_format(o).alias("direct"))


@query(f"""WITH {PAIRS} SELECT pair_id, md5('### Instruction:' || chr(10) || prompt || chr(10) || chr(10) || '### Response:' || chr(10) || reference) AS digest FROM
(SELECT pair_id, prompt, reference FROM p)""".replace("md5('### Instruction:'", "md5('Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:'"))
def template_render(spark, d):
    p = pairs(spark, d)
    turns = F.array(F.struct(F.col("prompt").alias("user"), F.col("reference").alias("assistant")))
    return p.select("pair_id", F.md5(templates.render("alpaca", turns)).alias("digest"))


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
l AS (SELECT doc_id, coalesce(count(term), 0) AS len FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS av FROM l),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
tf AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT item_id, count(*) AS n, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))), 3) AS total FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY item_id""".replace("count(*) AS n, round", "count(DISTINCT doc_id) AS n_docs, round"))
def bm25_totals(spark, d):
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").withColumnRenamed("text", "q")
    got = retrieval.bm25(docs, q, "doc_id", "text", "item_id", "q")
    return got.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.sum("score"), 3).alias("total"))


# Rules for Chinese text, over rows that are stated here: the tables hold none.

_LONG = "天下大乱而诸侯并起争夺中原百姓流离失所不能安居乐业"
_MARKED = "天下大乱，而诸侯并起，争夺中原。百姓流离失所，不能安居乐业。"
_COMMAS = _MARKED.replace("。", "，")
CLEANING = [
    ("c2m", "译", "学而时习之", "学习并且时常温习", ""),
    ("c2m", "译", "学而时习之", "学习并且时常温习", "Yes"),
    ("poem", "译", "学而时习之", "学习并且时常温习", ""),
    ("m2c", "译", " ", "学而时习之", ""),
    ("m2c", "　", "学习并且时常温习", "学而时习之", ""),
    ("c2m", "译", "学而　", "学习", ""),
    ("c2m", "译", "学" * 501, "学习", ""),
    ("punctuate", "点", _LONG, _LONG, ""),
    ("punctuate", "点", _LONG, _MARKED, ""),
    ("punctuate", "点", _LONG, _COMMAS, ""),
    ("punctuate", "点", _LONG, _LONG + "。" + " " * 40, ""),
    ("punctuate", "点", "学而时习之", "。学而时习之", ""),
    ("punctuate", "点", "学而时习之", "，学而时习之", ""),
    ("punctuate", "点", "”学而时习之", "。学而时习之", ""),
    ("punctuate", "点", "学而时习之", "学而时习也。", ""),
    ("punctuate", "点", "王曰其言可也善", "王曰：“其言‘可也’，善。”", ""),
    ("punctuate", "点", "王曰其言可也善", "王曰：“其言‘可也”，善。’", ""),
    ("punctuate", "点", "，。；！", "学而时习之。", ""),
    ("c2m", "译", "元嘉三年四月帝幸建康宫室大臣朝贺", "公司股票价格上涨百分之五市场情绪乐观", ""),
    ("c2m", "译", "同文同文同文", "同文，同文同文。", ""),
    ("c2m", "译", "天下大乱诸侯并起争夺", "乱", ""),
    ("c2m", "译", "天下大乱诸侯并起争夺", "abc", ""),
]


def _values(name: str, rows: list[tuple], columns: str) -> str:
    """A CTE of stated rows, numbered by id."""
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"{name}(id, {columns}) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(rows)) + ")"


def _rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + columns)


_TIDY = "task, instruction, source, output, box"
_BALANCED = "regexp_replace(output, '[^“”‘’「」『』]', '', 'g')"
for _ in range(4):
    _BALANCED = f"regexp_replace({_BALANCED}, '“”|‘’|「」|『』', '', 'g')"
_DENSITY = "length(regexp_replace(output, '[^，。！？；：、,.!?;:]', '', 'g')) / greatest(length(y), 1)::DOUBLE"
_LEADS = f"regexp_matches(ltrim(output), '^[。！？.!?]') AND NOT regexp_matches({_strip('source')}, '^[”’」』》\"]')"


@query(f"""WITH {_values("r", CLEANING, _TIDY)}, n AS (SELECT *, lower(regexp_replace({_strip("source")}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS x, lower(regexp_replace({_strip("output")}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS y, {_strip("source")} AS a FROM r)
SELECT id, CASE WHEN task NOT IN ('c2m', 'm2c', 'punctuate') THEN 'unsupported_task' WHEN lower(box) IN ('1', 'true', 'yes', 'y') THEN 'has_box'
  WHEN {_strip("instruction")} = '' OR a = '' OR {_strip("output")} = '' THEN 'missing_text' WHEN length(a) < 4 THEN 'input_too_short' WHEN length(a) > 500 THEN 'input_too_long'
  WHEN task <> 'punctuate' THEN 'accepted' WHEN x <> '' AND y <> '' AND x <> y THEN 'punctuation_text_mismatch'
  WHEN length(x) >= 20 AND {_DENSITY} < 0.05 THEN 'insufficient_punctuation' WHEN length(x) >= 20 AND NOT regexp_matches(output, '[。！？；：.!?;:]') THEN 'missing_sentence_boundary_punctuation'
  WHEN {_BALANCED} <> '' THEN 'unbalanced_quotes' WHEN {_LEADS} THEN 'leading_boundary_punctuation' ELSE 'accepted' END AS reason FROM n""")
def clean_reasons_zh(spark, d):
    c = F.col
    rows = _rows(spark, CLEANING, "task string, instruction string, source string, output string, box string")
    return rows.select("id", quality.clean_reason(c("task"), c("source"), c("output"), c("box"), instruction=c("instruction")).alias("reason"))


def _cjk(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({x}, '[\\x{{3400}}-\\x{{9fff}}]')), lambda z: NOT contains('之其而以于为者也矣乎焉乃则所与及不无有是曰云人将中上下来', z))"


_DATES = "'[0-9]+|[〇零一二三四五六七八九十百千]+[年月日]'"


@query(f"""WITH {_values("r", CLEANING, _TIDY)}, n AS (SELECT *, {_audit("source")} AS x, {_audit("output")} AS y, {_cjk("source")} AS p, {_cjk("output")} AS q FROM r),
f AS (SELECT id, list_filter([
  CASE WHEN {_strip("source")} = '' OR {_strip("output")} = '' THEN 'missing_pair' END, CASE WHEN task <> 'punctuate' AND x <> '' AND x = y THEN 'identical_input_output' END,
  CASE WHEN task = 'punctuate' AND x <> '' AND y <> '' AND x <> y THEN 'punctuation_text_mismatch' END, CASE WHEN task = 'punctuate' AND length(x) >= 20 AND {_DENSITY} < 0.05 THEN 'insufficient_punctuation' END,
  CASE WHEN task = 'punctuate' AND length(x) >= 20 AND NOT regexp_matches(output, '[。！？；：.!?;:]') THEN 'missing_sentence_boundary_punctuation' END,
  CASE WHEN task = 'punctuate' AND {_BALANCED} <> '' THEN 'unbalanced_quotes' END, CASE WHEN task = 'punctuate' AND {_LEADS} THEN 'leading_boundary_punctuation' END,
  CASE WHEN length(y) < 2 THEN 'output_too_short' END, CASE WHEN length(x) >= 8 AND (length(y) / length(x)::DOUBLE < 0.2 OR length(y) / length(x)::DOUBLE > 4) THEN 'extreme_length_ratio' END,
  CASE WHEN len(regexp_extract_all(output, '[\\x{{3400}}-\\x{{9fff}}]')) < 2 THEN 'low_cjk_output' END,
  CASE WHEN len(p) >= 6 AND len(q) >= 6 AND len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q)))::DOUBLE < 0.05 THEN 'low_character_overlap' END,
  CASE WHEN len(regexp_extract_all(source, {_DATES})) > 0 AND NOT list_has_any(regexp_extract_all(source, {_DATES}), regexp_extract_all(output, {_DATES})) THEN 'number_or_date_mismatch' END], lambda z: z IS NOT NULL) AS flags FROM n)
SELECT id, array_to_string(flags, ',') AS flags FROM f""")
def audit_flags_zh(spark, d):
    c = F.col
    rows = _rows(spark, CLEANING, "task string, instruction string, source string, output string, box string")
    return rows.select("id", F.array_join(quality.audit_flags(c("task"), c("source"), c("output")), ",").alias("flags"))


TRIAGE = [
    ("c2m", "元嘉三年四月帝幸建康", "元嘉三年四月，皇帝到建康。", "元嘉三年四月，皇帝去了建康。"),
    ("c2m", "元嘉三年四月帝幸建康", "元嘉三年四月，皇帝到建康。", "元嘉五年四月，皇帝到建康。"),
    ("c2m", "学而时习之", "学了又时常温习它", "学了三日又时常温习它"),
    ("c2m", "学而时习之", "学了又时常温习它", "学而，时习之。"),
    ("c2m", "学而时习之", "学了又时常温习它", " "),
    ("m2c", "学了又时常温习它", "学而时习之", "学而时习之学而时习之"),
    ("m2c", "学了又时常温习它", "学而时习之", "学"),
    ("punctuate", "三年帝崩", "三年，帝崩。", "五年，帝崩。"),
    ("punctuate", "三年帝崩", "三年，帝崩。", "三年帝崩。"),
    ("punctuate", "三年帝崩", "三年，帝崩。", ""),
]


@query(f"""WITH {_values("v", TRIAGE, "task, prompt, reference, candidate")}, c AS (SELECT id AS pair_id, * FROM v), {_f1("f", "candidate", "reference")},
t AS (SELECT pair_id, task, f1, length({_nows("candidate")}) / greatest(length({_nows("reference")}), 1)::DOUBLE AS ratio, list_filter([
  CASE WHEN {_nows("candidate")} = '' THEN 'empty_output' END, CASE WHEN task = 'punctuate' AND {_core("prompt")} <> {_core("candidate")} THEN 'punctuation_text_changed' END,
  CASE WHEN task <> 'punctuate' AND {_core("prompt")} <> '' AND {_core("prompt")} = {_core("candidate")} THEN 'source_echo' END,
  CASE WHEN task <> 'punctuate' AND ratio < 0.65 THEN 'omission_risk' END, CASE WHEN task <> 'punctuate' AND ratio > 1.55 THEN 'over_translation_risk' END, CASE WHEN task <> 'punctuate' AND f1 < 0.4 THEN 'low_reference_overlap' END,
  CASE WHEN task <> 'punctuate' AND len({_num("reference")}) > 0 AND {_num("candidate")} <> {_num("reference")} THEN 'number_or_date_mismatch_risk' END], lambda x: x IS NOT NULL) AS flags FROM c JOIN f USING (pair_id))
SELECT pair_id, array_to_string(flags, ',') AS flags FROM t""")
def triage_zh(spark, d):
    c = _rows(spark, TRIAGE, "task string, prompt string, reference string, candidate string").withColumnRenamed("id", "pair_id")
    c = c.join(metrics.char_scores(c, "pair_id", "candidate", "reference").select("pair_id", "char_f1"), "pair_id")
    flags = evals.triage_flags(F.col("task"), F.col("prompt"), F.col("candidate"), F.col("reference"), F.col("char_f1"))
    return c.select("pair_id", F.array_join(flags, ",").alias("flags"))


CORRECTIONS = [
    ("a", "train", "High", "新", "旧"), ("a", "test", "high", "新", "旧"), ("b", None, "high", "新", "旧"), ("c", "test", "high", "新", "旧"), ("c", "train", "low", "新", "旧"),
    ("c", "train", "high", "旧 文", " 旧   文"), ("c", "train", "high", "新", "旧"), ("c", "train", "high", "新", "旧"), ("z", "train", "HIGH", "新", "旧"), (" ", "train", "high", "新", "旧"), ("d", "train", None, "新", "旧"), ("d", "train", "high", "", "旧"),
]


@query(f"""WITH {_values("r", CORRECTIONS, "key, split, confidence, approved, original")}, s AS (SELECT *, {_strip("regexp_replace(approved, '" + WS + "+', ' ', 'g')")} AS a, {_strip("regexp_replace(original, '" + WS + "+', ' ', 'g')")} AS o FROM r),
t AS (SELECT *, CASE WHEN trim(key) = '' THEN 'missing_or_duplicate_id' WHEN coalesce(split, 'train') <> 'train' THEN 'not_training_split' WHEN coalesce(lower(confidence), '') <> 'high' THEN 'not_high_confidence'
  WHEN key NOT IN ('a', 'b', 'c', 'd') THEN 'id_not_found_in_training' WHEN a = '' OR o = '' OR a = o THEN 'empty_or_identical_pair' ELSE 'accepted' END AS reason FROM s),
w AS (SELECT key, min(id) AS first FROM t WHERE reason = 'accepted' GROUP BY key)
SELECT t.id AS ordinal, CASE WHEN t.id > w.first THEN 'missing_or_duplicate_id' ELSE reason END AS reason FROM t LEFT JOIN w USING (key)""")
def correction_reasons(spark, d):
    rows = _rows(spark, CORRECTIONS, "key string, split string, confidence string, approved_reference string, original_reference string")
    rows = rows.withColumnRenamed("id", "ordinal").withColumnRenamed("key", "id")
    training = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    return review.correction_pairs(rows, training).select("ordinal", "reason")


@query("""SELECT doc_id FROM documents ORDER BY sha256('42' || chr(0) || 'replay' || chr(0) || doc_id || chr(0) || coalesce(source, '')) LIMIT 50""")
def stable_sample(spark, d):
    return sampling.hash_sample(table(spark, d, "documents").select("doc_id", "source"), 50, 42, "replay", "doc_id", "source").select("doc_id")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 > 0),
p AS (SELECT doc_id AS pred_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id % 4 > 0)
SELECT doc_id, pred_id FROM r JOIN p USING (source, k)""")
def fifo_matches(spark, d):
    docs = table(spark, d, "documents")
    refs = docs.where("doc_id % 3 > 0").select("doc_id", F.concat(F.lit(" "), "source").alias("input"), F.col("doc_id").alias("ordinal"))
    preds = docs.where("doc_id % 4 > 0").select(F.col("doc_id").alias("pred_id"), F.col("source").alias("inp"), F.col("doc_id").alias("ordinal"))
    return evals.fifo_join(refs, preds, "input", "inp").select("doc_id", "pred_id")


@query(f"""WITH {PAIRS} SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN 'not_punctuation' WHEN {_nows("prompt")} = '' OR {_nows("y")} = '' THEN 'empty_text' WHEN length({_nows("prompt")}) < 60 THEN 'source_too_short'
  WHEN length({_nows("prompt")}) > 120 THEN 'source_too_long' WHEN {_core("prompt")} <> {_core("y")} THEN 'reference_changes_source' ELSE 'accepted' END AS reason
FROM (SELECT *, CASE WHEN pair_id % 3 = 0 THEN reference ELSE prompt || '.' END AS y FROM p)""")
def grpo_reasons(spark, d):
    p = pairs(spark, d).withColumn("y", F.when(F.col("pair_id") % 3 == 0, F.col("reference")).otherwise(F.concat("prompt", F.lit("."))))
    task = F.when(F.col("pair_id") % 5 == 0, "c2m").otherwise("punctuate")
    return p.select("pair_id", quality.grpo_reason(task, F.col("prompt"), F.col("y"), 60, 120).alias("reason"))


@query(f"""WITH {CANDIDATES} SELECT pair_id, CASE WHEN pair_id % 4 = 0 THEN 'missing_conversations' WHEN trim(a) = '' OR trim(b) = '' THEN 'missing_preference' WHEN a = b THEN 'identical_preference' ELSE 'accepted' END AS reason
FROM (SELECT pair_id, trim(regexp_replace(coalesce(reference, ''), '{WS}+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(baseline, ''), '{WS}+', ' ', 'g')) AS b FROM c)""")
def preference_reasons(spark, d):
    conv = F.when(F.col("pair_id") % 4 != 0, convo.from_qa(F.col("prompt"), F.col("reference")))
    return candidates(spark, d).select("pair_id", review.preference_reason(conv, F.col("reference"), F.col("baseline")).alias("reason"))


@query("""WITH x AS (SELECT doc_id, unnest(range(1, 10)) AS i FROM documents) SELECT round(avg((((doc_id * (i - 1)) % 5) = ((doc_id + i) % 5))::INTEGER), 9) AS accuracy FROM x WHERE i % 4 <> 0""")
def token_accuracy(spark, d):
    i = F.sequence(F.lit(0), F.lit(9))
    rows = table(spark, d, "documents").select(F.transform(i, lambda k: (F.col("doc_id") * k) % 5).alias("p"), F.transform(i, lambda k: F.when(k % 4 == 0, F.lit(-100)).otherwise((F.col("doc_id") + k) % 5)).alias("l"))
    return evals.token_accuracy(rows, "p", "l").select(F.round("accuracy", 9).alias("accuracy"))


@query("""SELECT round(exp(sum((doc_id % 7) * 0.01 * n_chars) / (count(*) * sum(n_chars))), 9) AS perplexity FROM documents""")
def corpus_perplexity(spark, d):
    rows = table(spark, d, "documents").select(((F.col("doc_id") % 7) * 0.01).alias("nll"), "n_chars")
    return evals.perplexity(rows, "nll", "n_chars", "n_chars").select(F.round("perplexity", 9).alias("perplexity"))


_FORMATS = [(t.name, t.prompt, t.sep, t.system) for t in templates.TEMPLATES.values()]


@query(f"""WITH {_values("t", _FORMATS, "name, prompt, sep, sys")}, {PAIRS}, q AS (SELECT prompt AS a, reference AS b FROM p ORDER BY pair_id LIMIT 1)
SELECT name, md5(CASE WHEN sys <> '' THEN sys || sep ELSE '' END || replace(t.prompt, '{{query}}', a) || b || sep || replace(t.prompt, '{{query}}', b) || a) AS digest FROM t, q""")
def template_formats(spark, d):
    q = pairs(spark, d).orderBy("pair_id").limit(1)
    turn = lambda a, b: F.struct(F.col(a).alias("user"), F.col(b).alias("assistant"))
    turns = F.array(turn("prompt", "reference"), turn("reference", "prompt"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.md5(templates.render(n, turns)).alias("digest")) for n in templates.TEMPLATES])).alias("x")
    return q.select(each).select("x.name", "x.digest")


def _judged(out: str, f1: str) -> str:
    """The flags of an output of the tasks c2m and m2c, as a list."""
    ratio = f"(length({_nows(out)}) / greatest(length({_nows('reference')}), 1)::DOUBLE)"
    return f"""list_filter([CASE WHEN {_nows(out)} = '' THEN 'empty_output' END, CASE WHEN {_core("prompt")} <> '' AND {_core("prompt")} = {_core(out)} THEN 'source_echo' END,
  CASE WHEN {ratio} < 0.65 THEN 'omission_risk' END, CASE WHEN {ratio} > 1.55 THEN 'over_translation_risk' END, CASE WHEN {f1} < 0.4 THEN 'low_reference_overlap' END,
  CASE WHEN len({_num("reference")}) > 0 AND {_num(out)} <> {_num("reference")} THEN 'number_or_date_mismatch_risk' END], lambda x: x IS NOT NULL)"""


def _both(spark, d) -> DataFrame:
    """The pairs with both outputs' scores in f1."""
    c = candidates(spark, d)
    for m in ("baseline", "candidate"):
        c = c.join(metrics.char_scores(c, "pair_id", m, "reference").select("pair_id", F.col("char_f1").alias(f"{m}_f1")), "pair_id")
    return c


_BOTH = f"""WITH {CANDIDATES}, {_f1("fa", "baseline", "reference")}, {_f1("fb", "candidate", "reference")},
s AS (SELECT c.*, fa.f1 AS fa, fb.f1 AS fb, length({_nows("baseline")}) / greatest(length({_nows("reference")}), 1)::DOUBLE AS la, length({_nows("candidate")}) / greatest(length({_nows("reference")}), 1)::DOUBLE AS lb,
  CASE WHEN {_nows("baseline")} = {_nows("reference")} THEN 1.0::DOUBLE ELSE 0 END AS ea, CASE WHEN {_nows("candidate")} = {_nows("reference")} THEN 1.0::DOUBLE ELSE 0 END AS eb FROM c JOIN fa USING (pair_id) JOIN fb USING (pair_id))"""


def _side(m: str, x: str) -> str:
    return f"""round(avg(e{x}), 6) AS {m}_exact, round(avg(f{x}), 6) AS {m}_f1, round(avg(l{x}), 6) AS {m}_length_ratio, count(CASE WHEN {_nows(m)} = '' THEN 1 END) AS {m}_empty,
  count(CASE WHEN contains({m}, '<think>') OR contains({m}, '<answer>') THEN 1 END) AS {m}_leaks"""


@query(f"""{_BOTH} SELECT task, count(*) AS n, {_side("baseline", "a")}, {_side("candidate", "b")}, round(avg(eb) - avg(ea), 6) AS exact_delta, round(avg(fb) - avg(fa), 6) AS f1_delta, round(avg(lb) - avg(la), 6) AS length_ratio_delta,
  count(CASE WHEN fb - fa > 1e-12 THEN 1 END) AS wins, count(CASE WHEN abs(fb - fa) <= 1e-12 THEN 1 END) AS ties, count(CASE WHEN fb - fa < -1e-12 THEN 1 END) AS losses FROM s GROUP BY ROLLUP (task)""")
def ab_sections(spark, d):
    c, r = _both(spark, d), F.col("reference")
    for m in ("baseline", "candidate"):
        c = c.withColumns({f"{m}_output": F.col(m), f"{m}_exact": T.exact_match(F.col(m), r).cast("double"), f"{m}_length_ratio": T.length_ratio(F.col(m), r)})
    return evals.model_sections(c, "task")


@query(f"""{_BOTH}, t AS (SELECT task, fb - fa AS delta, {_judged("baseline", "fa")} AS x, {_judged("candidate", "fb")} AS y FROM s),
u AS (SELECT task, 'rows' AS model, 'rows' AS flag FROM t UNION ALL SELECT task, 'baseline', unnest(x) FROM t UNION ALL SELECT task, 'candidate', unnest(y) FROM t
  UNION ALL SELECT task, 'comparison', CASE WHEN delta < 0 THEN 'regression' ELSE 'improvement' END FROM t WHERE abs(delta) > 0.05 UNION ALL SELECT task, 'comparison', 'new_' || unnest(list_filter(y, lambda z: NOT list_contains(x, z))) FROM t)
SELECT task, model, flag, count(*) AS n FROM u GROUP BY ALL""")
def triage_summary(spark, d):
    c = _both(spark, d)
    flags = lambda m: evals.triage_flags(F.col("task"), F.col("prompt"), F.col(m), F.col("reference"), F.col(f"{m}_f1"))
    c = c.withColumns({"x": flags("baseline"), "y": flags("candidate"), "delta": F.col("candidate_f1") - F.col("baseline_f1")})
    return evals.triage_summary(c, "task", "x", "y", "delta")


@query(f"""SELECT count(*) AS n, round(avg(boundary_f1), 6) AS boundary_f1, round(avg(position_f1), 6) AS position_f1, round(avg(kept), 6) AS text_preserved, sum(kept)::BIGINT AS text_preserved_count
FROM ({_bounds(True)}) JOIN ({_bounds(False)}) USING (pair_id) JOIN (WITH {CANDIDATES} SELECT pair_id, CASE WHEN {_core("baseline")} = {_core("reference")} THEN 1 ELSE 0 END AS kept FROM c) USING (pair_id)""")
def punctuation_means(spark, d):
    c = candidates(spark, d)
    c = c.withColumn("text_preserved", metrics.text_preserved(F.col("baseline"), F.col("reference")))
    for typed, name in ((True, "boundary_f1"), (False, "position_f1")):
        c = c.join(metrics.boundary_scores(c, "pair_id", "baseline", "reference", typed=typed).select("pair_id", name), "pair_id")
    return evals.punctuation_means(c, "boundary_f1", "position_f1")


@query(_TRIAGE + " SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM t) WHERE flag IN ('source_echo', 'omission_risk', 'low_reference_overlap') GROUP BY 1")
def removed_by_flag(spark, d):
    return quality.removed_by_flag(_triage(spark, d), "flags", ["source_echo", "omission_risk", "low_reference_overlap", "unknown"])


_EXCHANGES = """s AS (SELECT *, coalesce(count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM conversations WHERE role IN ('user', 'assistant')),
x AS (SELECT conv_id, i, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role = 'user') AS a, coalesce(max(text) FILTER (role = 'assistant'), '') AS b FROM s GROUP BY conv_id, i HAVING count(CASE WHEN role = 'user' THEN 1 END) > 0)"""


@query(f"WITH {_EXCHANGES} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS pos, a AS user_text, b AS assistant_text FROM x")
def convo_exchanges(spark, d):
    c = convo.collected(table(spark, d, "conversations"))
    return c.select("conv_id", F.posexplode(convo.exchanges(F.col("messages"))).alias("pos", "x")).select("conv_id", "pos", F.col("x.user").alias("user_text"), F.col("x.assistant").alias("assistant_text"))


@query(f"""WITH {_EXCHANGES}, y AS (SELECT conv_id, i, 0 AS k, 'user' AS role, a AS text FROM x UNION ALL SELECT conv_id, i, 1, 'assistant', b FROM x WHERE b <> ''
  UNION ALL SELECT conv_id, -1, 0, 'system', text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'system' AND text <> '') WHERE rn = 1)
SELECT conv_id, md5(coalesce(string_agg(role || ':' || text, chr(1) ORDER BY i, k), '')) AS digest FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN y USING (conv_id) GROUP BY conv_id""")
def preference_prompts(spark, d):
    c = convo.collected(table(spark, d, "conversations")).withColumns({"chosen": F.lit("a"), "rejected": F.lit("b")})
    said = F.transform("prompt", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return convo.preferences(c, "messages").select("conv_id", F.md5(F.array_join(said, "\x01")).alias("digest"))


@query(f"""WITH {PAIRS} SELECT 'qa-' || pair_id AS id, md5(prompt || ' Let''s think step by step and output the final answer within \\boxed{{}}.' || chr(1) || CASE WHEN reference <> '' THEN reference ELSE 'No solution available.' END) AS digest FROM p""".replace("\\\\", "\\"))
def problem_conversations(spark, d):
    p = pairs(spark, d).select(F.col("pair_id").alias("ordinal"), F.col("prompt").alias("problem"), F.col("reference").alias("solution"))
    return convo.from_problem(p, "qa").select("id", F.md5(F.array_join(F.transform("conversations", lambda m: m["value"]), "\x01")).alias("digest"))


@query("""WITH a AS (SELECT source AS piece, min(doc_id) AS ordinal FROM documents WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT lang AS piece, min(doc_id) AS ordinal FROM documents WHERE lang IS NOT NULL GROUP BY 1),
c AS (SELECT piece, 0.0::DOUBLE AS score, 1 AS part, ordinal FROM b UNION ALL SELECT role, 0.0, 2, min(turn) FROM conversations GROUP BY role UNION ALL SELECT piece, 0.0, 2, ordinal FROM a)
SELECT piece, 1.5::DOUBLE AS score, 0 AS part, ordinal::BIGINT AS ordinal FROM a UNION ALL SELECT piece, score, part, ordinal::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY part, ordinal) AS rn FROM c WHERE piece NOT IN (SELECT piece FROM a)) WHERE rn = 1""")
def vocabulary_union(spark, d):
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    words = lambda c: docs.where(F.col(c).isNotNull()).select(F.col(c).alias("piece"), F.col("doc_id").alias("ordinal"))
    base = words("source").groupBy("piece").agg(F.min("ordinal").alias("ordinal")).withColumn("score", F.lit(1.5))
    roles = turns.select(F.col("role").alias("piece"), F.col("turn").cast("long").alias("ordinal"))
    return vocabulary.merged(base, words("lang"), roles.unionByName(words("source")))


@query("""SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1 ORDER BY freq DESC, word LIMIT 100""")
def frequent_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return vocabulary.most_frequent(words.groupBy("word").agg(F.count("*").alias("freq")), 100, ordinal="word")
