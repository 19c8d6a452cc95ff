"""Queries on recorded runs and on the bounds of drawn shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import geometry as G
from quarryline.operators.selection import dealt
from quarryline.sources import pinned as P

from .common import table


def recorded_chains(spark, d):
    """Orders as conversations whose line items are turns, as a run recorded them. A discount of 0.1 is a failure, and what comes
    after the first one was blocked; by part some records are unsound, name another cause, or are missing."""
    lines = table(spark, d, "lineitem")
    n = lines.count()
    # An order's lines are dealt once, and the window and the grouping by lines find them together.
    i = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.max(F.round("l_discount", 2) >= 0.1).alias("fails"))
    turn = F.col("l_linenumber") - 1
    first = F.min(F.when(F.col("fails"), turn)).over(Window.partitionBy("l_orderkey"))
    name = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id")
    t = i.select(name, turn.alias("turn"), "p", "fails", first.alias("first"))
    span = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n_turns")).select(name, "n_turns")
    key = F.concat("id", F.lit("#"), F.col("turn").cast("string"))
    blocked, failed = F.coalesce(F.col("turn") > F.col("first"), F.lit(False)), F.coalesce(F.col("turn") == F.col("first"), F.lit(False))
    odd = F.col("p") % 11
    cause = F.concat("id", F.lit("#"), F.when(odd == 1, F.col("turn")).otherwise(F.col("first")).cast("string"))
    error = F.when(blocked, F.struct(F.lit("dependency_failed").alias("code"), cause.alias("caused_by"))).when(
        failed, F.struct(F.when(odd == 2, "other").otherwise("generation_failed").alias("code"), F.lit(None).cast("string").alias("caused_by")))
    done = ~blocked & ~failed
    records = t.where(odd != 5).select(
        key.alias("key"), F.when(done, F.when(odd == 3, " 10k").otherwise("10k")).otherwise("").alias("output"), F.when(done, "success").otherwise("failure").alias("status"),
        (~blocked).alias("attempted"), F.when(blocked, "dependency_failed").when(failed, "error").otherwise("stop").alias("finish_reason"), error.alias("error"))
    return P.chain_faults(records, span, generated=True, n_rows=n)


def arc_bounds(spark, d):
    """Vectors as arcs: the box around each one, drawn and mirrored."""
    v = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(5)))
    curve = F.round(F.col("e4") * 2000) % 400
    box = G.arc_bounds(*(F.col(f"e{i}") * 100 for i in range(4)), curve, F.col("vec_id") % 2 == 1)
    found = v.select("vec_id", (curve + 0.0).alias("curve"), box.alias("b"))
    return found.select("vec_id", "curve", *((F.round(F.col(f"b.{c}"), 4) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")))


def text_extents(spark, d):
    """Names of parts as texts on a drawing, on two lines, of all alignments and turned by their size."""
    p = table(spark, d, "part")
    align = F.element_at(F.array(*map(F.lit, G.ALIGNMENTS)), (F.col("p_partkey") % len(G.ALIGNMENTS) + 1).cast("int"))
    box = G.text_bounds(F.concat("p_name", F.lit("\n"), "p_brand"), F.lit(0.0), F.lit(0.0), F.lit(1.6), F.col("p_size") * 15.0, F.col("p_partkey") % 4 == 1, align)
    rounded = F.transform(F.array(box), lambda b: F.struct(*((F.round(b[c], 3) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2"))))
    return p.select("p_partkey", F.inline(rounded))


QUERIES = {f.__name__: f for f in (recorded_chains, arc_bounds, text_extents)}

_POINTS = ", ".join(f"CASE WHEN fmod(fmod((CASE WHEN t > 0 THEN 1 ELSE -1 END) * ({k} * pi() / 2 - a) , 2 * pi()) + 2 * pi(), 2 * pi()) <= abs(t) + 1e-12 THEN [cx + r * {c}, cy + r * {s}] END"
                    for k, (c, s) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1))))
ORACLES = {
    "recorded_chains": """
WITH i AS (SELECT 'o' || l_orderkey AS id, l_linenumber - 1 AS turn, min(l_partkey) % 11 AS odd, bool_or(round(l_discount, 2) >= 0.1) AS fails FROM lineitem GROUP BY ALL),
  t AS (SELECT *, max(turn) OVER (PARTITION BY id) AS last, min(CASE WHEN fails THEN turn END) OVER (PARTITION BY id) AS first, min(CASE WHEN fails AND odd <> 5 THEN turn END) OVER (PARTITION BY id) AS seen FROM i),
  a AS (SELECT id, unnest(range(0, max(last) + 1)) AS turn FROM t GROUP BY id),
  r AS (SELECT *, coalesce(turn > first, false) AS blocked, coalesce(turn = first, false) AS failed FROM t WHERE odd <> 5),
  s AS (SELECT *, min(CASE WHEN blocked OR failed THEN turn END) OVER (PARTITION BY id) AS broke FROM r),
  f AS (SELECT id || '#' || turn AS key, CASE WHEN NOT blocked AND NOT failed AND odd = 3 THEN 'unsound success'
    WHEN coalesce(turn > broke, false) THEN CASE WHEN NOT blocked OR (CASE WHEN odd = 1 THEN turn ELSE first END) <> broke THEN 'not blocked by its cause' END
    WHEN blocked OR (failed AND odd = 2) THEN 'unsound generation failure' END AS fault FROM s)
SELECT key, fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT a.id || '#' || a.turn, 'no record' FROM a LEFT JOIN r ON r.id = a.id AND r.turn = a.turn WHERE r.id IS NULL""",
    "arc_bounds": f"""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x1, embedding[2]::DOUBLE * 100 AS y1, embedding[3]::DOUBLE * 100 AS x2, embedding[4]::DOUBLE * 100 AS y2, round(embedding[5]::DOUBLE * 2000) AS e, e - 400 * trunc(e / 400) AS curve FROM embeddings),
  t AS (SELECT *, radians(curve) * CASE WHEN vec_id % 2 = 1 THEN 1 ELSE -1 END AS t FROM v),
  c AS (SELECT *, (x1 + x2) / 2 - (y2 - y1) / (2 * tan(t / 2)) AS cx, (y1 + y2) / 2 + (x2 - x1) / (2 * tan(t / 2)) AS cy, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / (2 * abs(sin(t / 2))) AS r FROM t),
  a AS (SELECT *, atan2(y1 - cy, x1 - cx) AS a FROM c),
  p AS (SELECT *, list_concat([[x1, y1], [x2, y2]], CASE WHEN abs(curve) > 0.001 THEN [{_POINTS}] ELSE [] END) AS p FROM a),
  b AS (SELECT vec_id, min(q[1]) AS x1, min(q[2]) AS y1, max(q[1]) AS x2, max(q[2]) AS y2 FROM (SELECT vec_id, unnest(p) AS q FROM p WHERE abs(curve) < 360) GROUP BY 1)
SELECT v.vec_id, curve, round(b.x1, 4) + 0.0::DOUBLE AS x1, round(b.y1, 4) + 0.0::DOUBLE AS y1, round(b.x2, 4) + 0.0::DOUBLE AS x2, round(b.y2, 4) + 0.0::DOUBLE AS y2 FROM v LEFT JOIN b USING (vec_id)""",
    "text_extents": """
WITH k(i, h, d) AS (VALUES (0, -1, 1), (1, 0, 1), (2, 1, 1), (3, -1, 0), (4, 0, 0), (5, 1, 0), (6, -1, -1), (7, 0, -1), (8, 1, -1)),
  t AS (SELECT p_partkey, greatest(length(p_name), length(p_brand)) * 1.6 AS w, (p_size * 15) % 360 AS g, p_partkey % 4 = 1 AS m, h, d FROM part JOIN k ON i = p_partkey % 9),
  u AS (SELECT *, g > 90 AND g <= 270 AS flip FROM t),
  s AS (SELECT p_partkey, w, radians(-CASE WHEN flip THEN (g + 180) % 360 ELSE g END) AS a, h * CASE WHEN m THEN -1 ELSE 1 END * CASE WHEN flip THEN -1 ELSE 1 END AS h, d * CASE WHEN flip THEN -1 ELSE 1 END AS d FROM u),
  e AS (SELECT p_partkey, a, CASE WHEN h > 0 THEN [-w, 0] WHEN h = 0 THEN [-w / 2, w / 2] ELSE [0, w] END::DOUBLE[] AS xs,
    CASE WHEN d > 0 THEN [-2.0 - 2.08, 0.16] WHEN d = 0 THEN [-1.0 - 1.12, 1.0 + 1.12] ELSE [-0.16, 2.0 + 2.08] END::DOUBLE[] AS ys FROM s),
  c AS (SELECT p_partkey, a, unnest([xs[1], xs[1], xs[2], xs[2]]) AS x, unnest([ys[1], ys[2], ys[1], ys[2]]) AS y FROM e)
SELECT p_partkey, round(min(x * cos(a) - y * sin(a)), 3) + 0.0::DOUBLE AS x1, round(min(x * sin(a) + y * cos(a)), 3) + 0.0::DOUBLE AS y1,
  round(max(x * cos(a) - y * sin(a)), 3) + 0.0::DOUBLE AS x2, round(max(x * sin(a) + y * cos(a)), 3) + 0.0::DOUBLE AS y2 FROM c GROUP BY 1""",
}
