"""Queries on conversations: turns, blocking, rates, probes, prefixes and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import conversations as C

from .common import THE, refuses_sql, table


def _turns(spark, d):
    return C.blocked(C.user_turns(table(spark, d, "conversations")))


def turn_keys(spark, d):
    return C.user_turns(table(spark, d, "conversations")).select("conv_id", "key", "turn")


def role_alternation(spark, d):
    return C.alternation_faults(table(spark, d, "conversations"))


def dependency_blocking(spark, d):
    return _turns(spark, d).select("key", "status", "caused_by")


def benchmark_summary(spark, d):
    t = _turns(spark, d)
    return t.agg(F.count("*").alias("turns"), F.count_if(F.col("status") != "dependency_failed").alias("attempted"),
                 F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"),
                 F.round(F.count_if(F.col("status") != "success") / F.count("*"), 6).alias("failure_rate"))


def failure_reasons(spark, d):
    return _turns(spark, d).where("status <> 'success'").groupBy("status").agg(F.count("*").alias("n"))


FLAGS = {"completion.rate": "status = 'success'", "completion.clean_rate": "status = 'success' and not spills",
         "followup.completion_rate": "if(n > 0, status = 'success', null)",
         "followup.clean_completion_rate": "if(n > 0, status = 'success' and not spills, null)",
         "value.literal_accuracy": "if(label = 0, states, null)", "followup.value_literal_accuracy": "if(label = 0 and n > 0, states, null)",
         "refusal.accuracy": "if(label > 0, refuses, null)", "refusal.missing_component_accuracy": "if(label = 1, refuses, null)",
         "refusal.measurement_accuracy": "if(label = 2, refuses, null)"}
#: Floors of the rates.
FLOORS = (("completion.rate", 1.0), ("completion.clean_rate", 1.0), ("followup.completion_rate", 1.0), ("followup.clean_completion_rate", 1.0),
          ("value.literal_accuracy", 0.95), ("followup.value_literal_accuracy", 0.95), ("refusal.accuracy", 0.98),
          ("refusal.missing_component_accuracy", 0.98), ("refusal.measurement_accuracy", 0.98))


def _measured(spark, d):
    """Turns with a label made for each: a value, a missing component or a measurement."""
    return _turns(spark, d).withColumns({
        "spills": X.spills_role(F.col("output")), "refuses": X.refuses(F.col("output")), "label": (F.col("conv_id") + F.col("n")) % 3,
        "states": X.states_value(X.final_answer(F.col("output")), F.lit("the"))})


def qualification_rates(spark, d):
    return C.rates(_measured(spark, d), [], FLAGS, required=True)


def floors_and_regressions(spark, d):
    floors = spark.createDataFrame(list(FLOORS), "metric string, floor double")
    t = _measured(spark, d)
    return C.qualified(C.rates(t.where("conv_id % 2 = 1"), [], FLAGS), C.rates(t.where("conv_id % 2 = 0"), [], FLAGS), floors)


def probe_triplets(spark, d):
    return C.probes(_turns(spark, d)).select("key", "variant", "n_turns", X.digest(F.col("prompt")).alias("prompt_sha256"))


def probe_reduce(spark, d):
    p = C.probes(_turns(spark, d))
    return C.rates(p, ["variant"], {"completed": "status = 'success'", "blocked": "status = 'dependency_failed'"})


def prefix_expansion(spark, d):
    return C.prefixes(table(spark, d, "conversations")).select("conv_id", "turn", "n_messages", X.digest(F.col("history")).alias("history_sha256"))


def answer_inventory(spark, d):
    """Answers by role: number, bytes, and digest of the sorted multiset of digests. Digests first meet
    in 256 classes, so that no task holds those of all answers."""
    c = table(spark, d, "conversations").where("text is not null")
    one = c.select("role", X.digest(F.col("text")).alias("h"), F.octet_length("text").cast("long").alias("b"))
    part = one.groupBy("role", F.substring("h", 1, 2).alias("c")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"), F.sum("b").alias("b"))
    return part.groupBy("role").agg(F.sum("n").alias("n"), F.sum("b").alias("n_bytes"), F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256).alias("multiset_sha256"))


def arms_equal(spark, d):
    """Answers that one of two arms has more often: even against odd conversations."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    n = c.groupBy("text").agg(F.count_if(F.col("conv_id") % 2 == 0).alias("even"), F.count_if(F.col("conv_id") % 2 == 1).alias("odd"))
    return n.where("even <> odd").agg(F.count("*").alias("n_texts"), F.coalesce(F.sum(F.abs(F.col("even") - F.col("odd"))), F.lit(0)).alias("n_extra"))


def _runs(spark, d):
    t = _turns(spark, d).select("key", "status", "output")
    b = t.where(F.length("output") % 11 != 3).withColumns({"status": F.when(F.length("output") % 5 == 0, "failure").otherwise(F.col("status")), "output": F.lower("output")})
    return C.compared(t.where(F.length("output") % 13 != 5), b)


def ab_pairs(spark, d):
    return _runs(spark, d).select("key", "a_status", "b_status", "kind")


def ab_filters(spark, d):
    return _runs(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def role_spill(spark, d):
    return table(spark, d, "conversations").where(X.spills_role(F.concat("text", F.lit("\nuser:"))) & ~X.spills_role(F.col("text"))).groupBy(
        "role").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    turn_keys, role_alternation, dependency_blocking, benchmark_summary, failure_reasons, qualification_rates, floors_and_regressions,
    probe_triplets, probe_reduce, prefix_expansion, answer_inventory, arms_equal, ab_pairs, ab_filters, role_spill)}

_T = """w AS (SELECT *, lead(role) OVER o AS nr, lead(text) OVER o AS nt FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
  u AS (SELECT conv_id, turn, text AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, coalesce(nr = 'assistant' AND length(nt) > 0, false) AS ok, nt FROM w WHERE role = 'user'),
  t0 AS (SELECT conv_id, n, turn, question, conv_id || '#' || n AS key, CASE WHEN ok THEN nt ELSE '' END AS output, NOT ok AS failed FROM u),
  t1 AS (SELECT *, first_value(CASE WHEN failed THEN key END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caused_by FROM t0),
  t AS (SELECT *, CASE WHEN caused_by IS NOT NULL THEN 'dependency_failed' WHEN failed THEN 'failure' ELSE 'success' END AS status FROM t1)"""
_M = f"""{_T}, m AS (SELECT *, regexp_matches(output, '(?im)^[ \\t]*(?:user|assistant|system)[ \\t]*:?[ \\t\\r]*$') AS spills, {refuses_sql('output')} AS refuses,
    (conv_id + n) % 3 AS label, regexp_matches(output, '{THE}', 'i') AS states FROM t),
  l AS (SELECT conv_id, unnest([{{'metric': 'completion.rate', 'hit': status = 'success'}}, {{'metric': 'completion.clean_rate', 'hit': status = 'success' AND NOT spills}},
    {{'metric': 'followup.completion_rate', 'hit': CASE WHEN n > 0 THEN status = 'success' END}},
    {{'metric': 'followup.clean_completion_rate', 'hit': CASE WHEN n > 0 THEN status = 'success' AND NOT spills END}},
    {{'metric': 'value.literal_accuracy', 'hit': CASE WHEN label = 0 THEN states END}}, {{'metric': 'followup.value_literal_accuracy', 'hit': CASE WHEN label = 0 AND n > 0 THEN states END}},
    {{'metric': 'refusal.accuracy', 'hit': CASE WHEN label > 0 THEN refuses END}}, {{'metric': 'refusal.missing_component_accuracy', 'hit': CASE WHEN label = 1 THEN refuses END}},
    {{'metric': 'refusal.measurement_accuracy', 'hit': CASE WHEN label = 2 THEN refuses END}}], recursive := true) FROM m)"""
_R = "SELECT metric, count(*) FILTER (hit) AS correct, count(*) AS total, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM l WHERE hit IS NOT NULL"
_P = f"""{_T}, z AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS size, first_value(question) OVER (PARTITION BY conv_id ORDER BY n) AS opening FROM t),
  p AS (SELECT key, status, unnest([{{'variant': 'standalone', 'prompt': question, 'n_turns': 1}}, {{'variant': 'explicit', 'prompt': opening || chr(10) || question, 'n_turns': 1}},
    {{'variant': 'contextual', 'prompt': question, 'n_turns': size}}], recursive := true) FROM z WHERE size >= 2 AND n = size - 1)"""
_AB = f"""{_T}, b AS (SELECT key, CASE WHEN length(output) % 5 = 0 THEN 'failure' ELSE status END AS b_status, lower(output) AS b_output FROM t WHERE length(output) % 11 <> 3),
  ab AS (SELECT key, status AS a_status, b_status, CASE WHEN status IS NULL THEN 'not in a' WHEN b_status IS NULL THEN 'not in b' WHEN status <> 'success' AND b_status <> 'success' THEN 'both fail' WHEN status <> 'success' THEN 'a fails'
    WHEN b_status <> 'success' THEN 'b fails' WHEN output <> b_output THEN 'texts differ' ELSE 'same' END AS kind FROM (SELECT * FROM t WHERE length(output) % 13 <> 5) FULL JOIN b USING (key))"""
_FLOORS = ", ".join(f"('{m}', {f}::DOUBLE)" for m, f in FLOORS)
ORACLES = {
    "turn_keys": f"WITH {_T} SELECT conv_id, key, turn FROM t",
    "role_alternation": """WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations),
        f AS (SELECT *, CASE WHEN role = previous THEN 'repeated role' WHEN role = 'system' AND previous IS NOT NULL THEN 'system not first'
          WHEN role = 'assistant' AND (previous IS NULL OR previous = 'system') THEN 'starts with assistant' END AS fault FROM p) SELECT conv_id, turn, role, fault FROM f WHERE fault IS NOT NULL""",
    "dependency_blocking": f"WITH {_T} SELECT key, status, caused_by FROM t",
    "benchmark_summary": f"""WITH {_T} SELECT count(*) AS turns, count(*) FILTER (status <> 'dependency_failed') AS attempted, count(*) FILTER (status = 'success') AS successful,
        count(*) FILTER (status <> 'success') AS failed, round(count(*) FILTER (status <> 'success') / count(*), 6) AS failure_rate FROM t""",
    "failure_reasons": f"WITH {_T} SELECT status, count(*) AS n FROM t WHERE status <> 'success' GROUP BY 1",
    "qualification_rates": f"WITH {_M} {_R} GROUP BY metric",
    "floors_and_regressions": f"""WITH {_M}, c AS ({_R} AND conv_id % 2 = 1 GROUP BY metric), b AS ({_R} AND conv_id % 2 = 0 GROUP BY metric), f(metric, floor) AS (VALUES {_FLOORS})
        SELECT f.metric, c.rate, f.floor, b.rate AS base_rate, CASE WHEN c.rate IS NULL THEN 'no evidence' WHEN c.rate < f.floor THEN 'below floor' WHEN c.rate < b.rate THEN 'regression' ELSE 'pass' END AS verdict
        FROM f LEFT JOIN c USING (metric) LEFT JOIN b USING (metric)""",
    "probe_triplets": f"WITH {_P} SELECT key, variant, n_turns, sha256(prompt) AS prompt_sha256 FROM p",
    "probe_reduce": f"""WITH {_P}, l AS (SELECT variant, unnest([{{'metric': 'completed', 'hit': status = 'success'}}, {{'metric': 'blocked', 'hit': status = 'dependency_failed'}}], recursive := true) FROM p)
        SELECT variant, metric, count(*) FILTER (hit) AS correct, count(*) AS total, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM l GROUP BY 1, 2""",
    "prefix_expansion": """SELECT conv_id, turn, count(*) OVER o AS n_messages, sha256(array_to_string(list(role || ': ' || coalesce(text, '')) OVER o, chr(10))) AS history_sha256
        FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    "answer_inventory": """WITH o AS (SELECT role, sha256(text) AS h, strlen(text) AS b FROM conversations WHERE text IS NOT NULL),
        p AS (SELECT role, substr(h, 1, 2) AS c, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n, sum(b) AS b FROM o GROUP BY 1, 2)
        SELECT role, sum(n)::BIGINT AS n, sum(b)::BIGINT AS n_bytes, sha256(string_agg(h, '' ORDER BY c)) AS multiset_sha256 FROM p GROUP BY 1""",
    "arms_equal": """WITH n AS (SELECT text, count(*) FILTER (conv_id % 2 = 0) AS e, count(*) FILTER (conv_id % 2 = 1) AS o FROM conversations WHERE role = 'assistant' GROUP BY 1)
        SELECT count(*) AS n_texts, coalesce(sum(abs(e - o)), 0)::BIGINT AS n_extra FROM n WHERE e <> o""",
    "ab_pairs": f"WITH {_AB} SELECT key, a_status, b_status, kind FROM ab",
    "ab_filters": f"WITH {_AB} SELECT kind, count(*) AS n FROM ab GROUP BY 1",
    "role_spill": """SELECT role, count(*) AS n FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?im)^[ \t]*(?:user|assistant|system)[ \t]*:?[ \t\r]*$') GROUP BY 1""",
}
