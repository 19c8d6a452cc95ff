"""Queries on rollouts, routing, viewer state and cancellations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import rollouts as R

from .common import table

#: Answers after a search without results; {r} and {v} are the part and its value.
SAID = (
    "No results were found.", "The search returned no results. {r} is marked {v}.", "I cannot verify the ratings from the search results; please provide the datasheet",
    "{v}", "No matches. It handles 5A!", "I CAN'T infer any specifications from an empty result.\n{r} is {v}\n", "  ", "Which part do you mean? Not measured.",
)


def _made(text: str, r, v):
    out = F.lit(text)
    return F.replace(F.replace(out, F.lit("{r}"), r), F.lit("{v}"), v)


def _parts(spark, d):
    """Parts with an answer to a search, taken in turn."""
    r, v = F.concat(F.lit("R"), F.col("p_partkey").cast("string")), F.regexp_replace("p_brand", "#", "-")
    said = F.element_at(F.array(*(_made(s, r, v) for s in SAID)), (F.col("p_partkey") % len(SAID) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_size", r.alias("refdes"), v.alias("value"), said.alias("content"))


def search_answers(spark, d):
    p = _parts(spark, d).select("p_partkey", R.search_answer(F.col("content"), F.col("refdes"), F.col("value")).alias("x"))
    return p.select("p_partkey", "x.*")


def final_answers(spark, d):
    fits = R.final_fits(F.concat("content", F.when(F.col("p_size") % 9 == 0, "\nUser: and?").otherwise("")), F.when(F.col("p_size") % 3 == 0, F.lower("value")),
                        F.col("p_size") % 3 == 1, F.col("p_size") % 2 == 0)
    return _parts(spark, d).select("p_partkey", fits.alias("fits"))


def clarifications(spark, d):
    """Documents that ask which part is meant, by language."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(R.clarifies(F.col("text"))).alias("n_asking"), F.count("*").alias("n"))


def routing_counts(spark, d):
    """Routing of calls made for parts: what was right, by kind."""
    k = F.col("p_size") % 6
    query = F.concat(F.lit('{"query": "'), F.upper("value"), F.lit(' datasheet"}'))
    label = F.concat(F.lit('{"label": "'), "refdes", F.lit('"}'))
    args = F.when(k == 0, query).when(k == 1, label).when(k == 2, F.concat(F.lit('{"page": 1, '), F.substring(label, 2, 100))).when(k == 3, "{oops").otherwise(label)
    tool = F.when(k == 0, "web_search").when(k < 4, "show_label")
    calls = F.when(k < 4, 1).when(F.col("p_size") % 12 == 4, 1).otherwise(0)
    made = _parts(spark, d).select(F.coalesce(tool, F.lit("clarify")).alias("kind"), "content", calls.alias("n_calls"), F.coalesce(tool, F.lit("show_label")).alias("function"),
                                   args.alias("arguments"), tool.alias("tool"), "refdes", F.col("value").alias("part"))
    return R.counted(R.routed(made), "kind")


def _turns(spark, d):
    """A tool result for each turn of a conversation: label, region, whole sheet, search, or none."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    x = (F.col("turn") * 10).cast("int")
    tool = F.when(k < 2, "show_label").when(k == 2, "show_region").when(k == 3, "show_full_sheet").when(k == 4, "web_search")
    event = F.struct(tool.alias("tool"), F.when(k == 1, "missing").otherwise("shown").alias("status"), F.array(x, x, x + 50, x + 60).alias("box"),
                     F.concat(F.lit("R"), F.col("turn").cast("string")).alias("label"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn")) % 11 == 0).alias("error"), (F.col("turn") % 4 == 3).alias("clears"),
        F.when(k < 5, F.array(event)).alias("events"), (F.col("conv_id") % 2 == 0).alias("allowed"))


def viewer_states(spark, d):
    s = R.viewed(_turns(spark, d), "conv_id", "turn")
    return s.select("conv_id", "turn", "blocked", F.array_join(F.col("before").cast("array<string>"), " ").alias("before"),
                    F.array_join(F.col("after").cast("array<string>"), " ").alias("after"), "focus", "still")


def rollout_report(spark, d):
    s = R.viewed(_turns(spark, d), "conv_id", "turn")
    return R.reported(s.withColumn("passed", ~F.col("blocked") & ~F.col("error") & (F.col("allowed") | F.col("still"))))


def pending_cancels(spark, d):
    """Starts of each user by whether they were cancelled; a cancellation waits for a day."""
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(k == 0, "start").when(k == 1, "cancel").otherwise("finish").alias("kind"))
    return R.cancelled(e, "user_id", "ts", "event_id", 86400).select("event_id", "cancelled")


QUERIES = {f.__name__: f for f in (search_answers, final_answers, clarifications, routing_counts, viewer_states, rollout_report, pending_cancels)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(c: str, forms) -> str:
    return f"regexp_full_match({c}, {_q('|'.join(forms))}, 'i')"


def _has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


_SAID = " ".join(f"WHEN {i} THEN replace(replace({_q(s)}, '{{r}}', 'R' || p_partkey), '{{v}}', replace(p_brand, '#', '-'))" for i, s in enumerate(SAID))
_P = f"p AS (SELECT p_partkey, p_size, 'R' || p_partkey AS refdes, replace(p_brand, '#', '-') AS value, CASE p_partkey % {len(SAID)} {_SAID} END AS content FROM part)"
_NAMED = "lower(c) IN (lower(value), " + ", ".join(f"lower(refdes || {_q(m)} || value)" for m in R.MARKED) + ")"
_V = """v AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, (conv_id * 7 + turn) % 11 = 0 AS error, turn % 4 = 3 AS clears, conv_id % 2 = 0 AS allowed FROM conversations),
    b AS (SELECT *, coalesce(max(error::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM v),
    m AS (SELECT *, CASE WHEN blocked THEN NULL WHEN k IN (0, 2) THEN concat_ws(' ', turn * 10, turn * 10, turn * 10 + 50, turn * 10 + 60) WHEN k = 3 THEN '0 0 1000 1000' END AS box,
          CASE WHEN blocked THEN NULL WHEN k = 0 THEN 'R' || turn WHEN k IN (2, 3) OR clears THEN '-' END AS f FROM b),
    w AS (SELECT *, coalesce(last_value(box IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '0 0 1000 1000') AS before,
          coalesce(last_value(box IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '0 0 1000 1000') AS after,
          nullif(last_value(f IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '-') AS focus FROM m),
    s AS (SELECT *, NOT blocked AND NOT error AND before = after AND k > 3 AS still FROM w)"""
ORACLES = {
    "search_answers": f"""WITH {_P}, c AS (SELECT p_partkey, refdes, value, trim(regexp_replace(unnest(regexp_split_to_array(content, '[.!?;\\n]+')), '\\s+', ' ', 'g')) AS c FROM p),
        j AS (SELECT p_partkey, {_matches('c', R.ABSTAINS)} AS says, {_matches('c', R.ABSTAINS + R.REQUESTS)} OR {_NAMED} AS fits FROM c WHERE c <> ''),
        n AS (SELECT p_partkey, bool_or(says) AS a, count(*) FILTER (NOT fits) AS u FROM j GROUP BY 1)
        SELECT p_partkey, coalesce(a, false) AS acknowledged, coalesce(u, 0) AS unknown, coalesce(a AND u = 0, false) AS passed FROM part LEFT JOIN n USING (p_partkey)""",
    "final_answers": f"""WITH {_P}, a AS (SELECT p_partkey, p_size, value, content || CASE WHEN p_size % 9 = 0 THEN chr(10) || 'User: and?' ELSE '' END AS c FROM p)
        SELECT p_partkey, regexp_matches(c, '\\S') AND p_size % 9 <> 0 AND (p_size % 3 <> 0 OR contains(lower(c), lower(value)))
          AND (p_size % 3 <> 1 OR (regexp_matches(c, {_q(R.ASKS)}, 'i') AND regexp_matches(c, '\\b({"|".join(R.NAMES)})\\b', 'i')))
          AND (p_size % 2 <> 0 OR {_has('lower(c)', R.DENIES)}) AS fits FROM a""",
    "clarifications": f"SELECT lang, count(*) FILTER (regexp_matches(lower(text), {_q(R.ASKS)}) AND {_has('lower(text)', R.NAMES)}) AS n_asking, count(*) AS n FROM documents GROUP BY 1",
    "routing_counts": f"""WITH {_P}, k AS (SELECT *, p_size % 6 AS k FROM p) SELECT CASE WHEN k = 0 THEN 'web_search' WHEN k < 4 THEN 'show_label' ELSE 'clarify' END AS kind,
        count(*) FILTER (k < 2 OR (k > 3 AND p_size % 12 <> 4 AND regexp_matches(lower(content), {_q(R.ASKS)}) AND {_has('lower(content)', R.NAMES)})) AS correct, count(*) AS total FROM k GROUP BY 1""",
    "viewer_states": f"WITH {_V} SELECT conv_id, turn, blocked, before, after, focus, still FROM s",
    "rollout_report": f"""WITH {_V} SELECT count(*) AS n_turns, count(*) FILTER (NOT blocked AND NOT error AND (allowed OR still)) AS n_passed, count(*) FILTER (NOT blocked AND NOT error) AS n_ended,
        count(*) FILTER (NOT allowed) AS n_held, count(*) FILTER (NOT allowed AND still) AS n_still, count(*) FILTER (NOT allowed AND NOT blocked AND k < 4) AS n_unasked FROM s""",
    "pending_cancels": """WITH e AS (SELECT event_id, user_id, ts, event_id % 3 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        SELECT s.event_id, EXISTS (SELECT 1 FROM e c WHERE c.user_id = s.user_id AND c.k = 1 AND c.n < s.n AND s.ts < c.ts + INTERVAL 86400 SECOND
            AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = s.user_id AND x.k <> 1 AND x.n > c.n AND x.n < s.n))
          OR EXISTS (SELECT 1 FROM e c WHERE c.user_id = s.user_id AND c.k = 1 AND c.n > s.n
            AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = s.user_id AND x.k <> 1 AND x.n > s.n AND x.n < c.n)) AS cancelled
        FROM e s WHERE s.k = 0""",
}
