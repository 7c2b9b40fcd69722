"""Queries over the driver's tables, each an operator or two of the library, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import detect, edges, episodes, intervene, labels, pairs, reach, shape
from .operators.components import connected_components
from .plans import analysis
from .plans.frame import COMPONENTS, PairConfig, from_events, with_documents
from .plans.shared import stored
from .sources.tables import exists

#: The tables' events are spread thin: with the default thresholds hardly a pair would be left to look at.
PLAIN = PairConfig(min_pair_score=0.12, min_edge_score=0.15)
#: Their vectors are nearly orthogonal: a lower floor. Ten events share a text on average, so that with the default of
#: three actors nearly every text would be a template: it takes ten here.
SEMANTIC = PLAIN.replace(semantic_floor=0.25, template_min_actors=10, common_cause_sim=0.2)
#: With the template rule at its default.
TEMPLATES = SEMANTIC.replace(template_min_actors=PairConfig.template_min_actors)
#: For the queries with SQL, which can't express the re-splitting of long and large components.
EPISODES = episodes.EpisodeConfig(gap_minutes=15, strong_pair_score=0.15, min_agents=2, min_events=3, max_hours=100_000, max_agents=1_000_000)
#: With the limits on hours and agents at their own values.
LIMITED = episodes.EpisodeConfig(gap_minutes=15, strong_pair_score=0.15, min_agents=2, min_events=3)
#: With limits that components of these tables exceed.
SPLIT = episodes.EpisodeConfig(gap_minutes=15, strong_pair_score=0.15, min_agents=2, min_events=3, max_hours=0.5, max_agents=4)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Frames that this process has stored, by application, kind and folder.
_frames: dict[tuple[str, str, str], DataFrame] = {}


def frame(spark: SparkSession, sf_dir: str, kind: str, **parts) -> DataFrame:
    """A stored frame, made once a session and folder: nearly every query starts from it and reads it several times."""
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _frames or not exists(spark, _frames[key].scratch_path):
        _frames[key] = stored(from_events(spark, sf_dir, **parts), kind)
    return _frames[key]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame without texts and vectors."""
    return frame(spark, sf_dir, "events", with_embeddings=False, with_content=False)


def full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With vectors, and of texts what pairs need: their hashes."""
    return frame(spark, sf_dir, "full-events")


def texts_of(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """The events of episodes with their texts; no other text is moved."""
    own = events(spark, sf_dir).join(members.select("rn").distinct(), "rn", "left_semi")
    return with_documents(own, sf_dir, F.col("content"))


def micros(name: str):
    return F.unix_micros(name).alias(name)


def flat(name: str):
    return F.array_join(F.array_sort(name), ",").alias(name)


EV = """
e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS eid, ts, epoch_us(ts) AS us, user_id, 'u' || user_id AS actor_id,
  CASE WHEN user_id % 10 = 0 THEN 'human' ELSE 'agent' END AS actor_type,
  CASE event_type WHEN 'error' THEN 'message' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'create' WHEN 'click' THEN 'tool_use' ELSE 'visit' END AS action_type,
  CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
  row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS rn FROM events),
ev AS (SELECT *, 'resource:k' || k AS res, CASE WHEN action_type = 'message' THEN 'u' || k END AS mention, CASE WHEN action_type = 'tool_use' THEN 't' || (k % 5) END AS tool,
  'g' || (user_id % 7) AS goal_key, 'o' || (user_id % 20) AS origin FROM e)
"""
BAND = "a.rn < b.rn AND b.us - a.us <= 7200000000 AND b.rn - a.rn <= 1500 AND b.actor_type = 'agent'"
CANDIDATES = f"""
rp AS (SELECT a.rn AS i, b.rn AS j, b.res AS resource FROM ev a JOIN ev b ON a.res = b.res AND {BAND} QUALIFY row_number() OVER (PARTITION BY b.rn, b.res ORDER BY a.rn DESC) <= 50),
reply AS (SELECT max(a.rn) AS i, b.rn AS j FROM ev a JOIN ev b ON a.actor_id = b.mention AND a.actor_type = 'agent' AND {BAND} GROUP BY b.rn, b.mention),
prev AS (SELECT rn, coalesce(lag(rn) OVER (PARTITION BY actor_id ORDER BY rn), -1) AS prev FROM ev WHERE actor_type = 'agent'),
inbox AS (SELECT a.rn AS i, b.rn AS j FROM ev a JOIN ev b ON a.mention = b.actor_id AND {BAND} JOIN prev p ON p.rn = b.rn WHERE a.rn > p.prev AND b.rn - a.rn <= 400)
"""
WEIGHTS = """
tot AS (SELECT greatest(1, count(DISTINCT actor_id) FILTER (actor_type = 'agent')) AS total FROM ev),
w AS (SELECT res AS resource, count(DISTINCT actor_id) AS n_agents,
  (CASE WHEN count(DISTINCT actor_id) / max(total) <= 0.5e0 THEN 1e0 ELSE greatest(0.1e0, 1 - count(DISTINCT actor_id) / max(total)) END)
  * (CASE WHEN count(DISTINCT actor_id) > 7 THEN least(1e0, 3e0 / log2(count(DISTINCT actor_id) + 1)) ELSE 1e0 END) AS weight FROM ev, tot GROUP BY res)
"""


def scored_sql(extra: str = "", sem: str = "0e0") -> str:
    return f"""
cand AS (SELECT i, j, max(a) AS addressed FROM (SELECT i, j, 0 AS a FROM rp UNION ALL SELECT i, j, 1 FROM reply UNION ALL SELECT i, j, 1 FROM inbox {extra}) GROUP BY i, j),
comp AS (SELECT i, j, a.actor_id AS src_agent, b.actor_id AS dst_agent, a.event_id AS src_event, b.event_id AS dst_event, a.us AS src_us, b.us AS dst_us, a.ts AS src_t, b.ts AS dst_t,
  (b.us - a.us) / 60000000e0 AS dt, exp(-((b.us - a.us) / 60000000e0) / 40e0) AS temporal, {sem} AS semantic,
  CASE WHEN a.action_type = 'visit' OR a.res <> b.res THEN 0e0 ELSE w.weight END AS resource, CASE WHEN a.action_type = 'visit' OR a.res <> b.res THEN '' ELSE a.res END AS shared_resources,
  CAST(addressed AS DOUBLE) AS direct, CASE WHEN a.goal_key = b.goal_key THEN 0.5e0 ELSE 0e0 END AS goal,
  CASE WHEN a.action_type <> b.action_type THEN 0e0 WHEN a.tool = b.tool THEN 1e0 WHEN a.action_type = 'message' THEN 0.3e0 ELSE 0.6e0 END AS action,
  CASE WHEN a.origin = b.origin THEN a.origin END AS same_origin, a.action_type AS src_action, a.tool AS src_tool
  FROM cand JOIN ev a ON a.rn = i JOIN ev b ON b.rn = j JOIN w ON w.resource = a.res WHERE a.actor_type = 'agent' AND a.actor_id <> b.actor_id),
raw AS (SELECT *, 0e0 + 0.15e0 * temporal + 0.3e0 * semantic + 0.25e0 * resource + 0.15e0 * direct + 0.05e0 * goal + 0.1e0 * action AS raw FROM comp),
pairs AS (SELECT i, j, src_agent, dst_agent, src_event, dst_event, src_us, dst_us, src_t, dst_t, round(dt, 2) AS dt_minutes, round(raw, 4) AS score, round(temporal, 4) AS temporal, round(semantic, 4) AS semantic,
  round(resource, 4) AS resource, direct, goal, action, shared_resources, same_origin, src_action, src_tool FROM raw
  WHERE (semantic <> 0 OR resource >= 0.15e0 OR direct <> 0 OR goal <> 0) AND raw >= 0.12e0)
"""


BASE = f"WITH RECURSIVE {EV}"
SCORED = f"{BASE}, {CANDIDATES}, {WEIGHTS}, {scored_sql()}"
PAIR_COLUMNS = "src_agent, dst_agent, src_event, dst_event, dt_minutes, score, temporal, semantic, resource, direct, goal, action, shared_resources, same_origin"


def pair_output(df: DataFrame) -> DataFrame:
    return df.select("src_agent", "dst_agent", "src_event", "dst_event", "dt_minutes", "score", *COMPONENTS, flat("shared_resources"), "same_origin")


# Frame


@query(f"{BASE} SELECT event_id, us, actor_id, actor_type, action_type, coalesce(mention, '') AS mentions, tool, res, rn FROM ev")
def canonical_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "us", "actor_id", "actor_type", "action_type", flat("mentions"), "tool", flat("res"), "rn")


@query(f"{BASE} SELECT event_id, us, actor_id FROM ev ORDER BY rn LIMIT 500")
def event_prefix(spark, sf_dir):
    return events(spark, sf_dir).orderBy("rn").limit(500).select("event_id", "us", "actor_id")


@query(f"{BASE} SELECT event_id, res AS resource FROM ev")
def touched_resources(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.explode("res").alias("resource"))


@query(f"{BASE} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS messages, count(DISTINCT actor_id) AS speakers FROM ev WHERE action_type = 'message' GROUP BY 1")
def daily_activity(spark, sf_dir):
    ev = events(spark, sf_dir).where("action_type = 'message'")
    return ev.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("actor_id").alias("speakers"))


@query(f"{BASE} SELECT (us // 600000000) * 600000000 AS bucket, count(*) AS n FROM ev GROUP BY 1")
def bucket_histogram(spark, sf_dir):
    return events(spark, sf_dir).groupBy((F.floor(F.col("us") / 600_000_000) * 600_000_000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT action_type, actor_type, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1, 2")
def source_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("action_type", "actor_type").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(r"""SELECT md5(t) AS text_md5, count(DISTINCT source) AS sources, count(*) AS n FROM (SELECT source, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM documents) WHERE t <> '' GROUP BY t HAVING count(*) > 1""")
def duplicate_texts(spark, sf_dir):
    t = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", t.alias("t")).where("t <> ''")
    return d.groupBy(F.md5("t").alias("text_md5")).agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("n")).where("n > 1")


# Candidates


@query(f"{BASE} SELECT a.rn AS i, b.rn AS j FROM ev a JOIN ev b ON {BAND}")
def band_pairs(spark, sf_dir):
    return pairs.band_pairs(events(spark, sf_dir), PLAIN)


@query(f"{BASE}, {CANDIDATES} SELECT i, j, resource FROM rp")
def resource_last50(spark, sf_dir):
    return pairs.resource_pairs(events(spark, sf_dir), PLAIN)


@query(f"{BASE}, {CANDIDATES} SELECT i, j FROM reply")
def reply_pairs(spark, sf_dir):
    return pairs.reply_pairs(events(spark, sf_dir), PLAIN)


@query(f"{BASE}, {CANDIDATES} SELECT i, j FROM inbox")
def inbox_pairs(spark, sf_dir):
    return pairs.inbox_pairs(events(spark, sf_dir), PLAIN)


@query(f"{BASE}, {WEIGHTS} SELECT resource, n_agents, round(weight, 8) AS weight FROM w")
def resource_weights(spark, sf_dir):
    return pairs.resource_weights(events(spark, sf_dir), PLAIN).withColumn("weight", F.round("weight", 8))


VECTORS = """
vec AS (SELECT rn, embedding FROM ev, (SELECT count(*) AS n FROM embeddings) c JOIN embeddings v ON v.vec_id = (k * 7 + user_id) % n),
said AS (SELECT rn, actor_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', ' ', 'g'))) AS t FROM ev, (SELECT count(*) AS n FROM documents) c LEFT JOIN documents d ON d.doc_id = eid % n),
text_of AS (SELECT rn, t <> '' AND n < 10 AS has_text FROM said JOIN (SELECT t, count(DISTINCT actor_id) AS n FROM said GROUP BY t) USING (t))
"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
NEAREST = f"""
sims AS (SELECT a.rn AS i, b.rn AS j, a.actor_id <> b.actor_id AS other, list_dot_product(CAST(va.embedding AS DOUBLE[]), CAST(vb.embedding AS DOUBLE[])) AS sim
  FROM ev a JOIN ev b ON {BAND} JOIN vec va ON va.rn = a.rn JOIN vec vb ON vb.rn = b.rn JOIN text_of t ON t.rn = b.rn AND t.has_text),
sp AS (SELECT * FROM (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(sim, 9) DESC, i) <= 15) WHERE other AND sim >= 0.25e0
  QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(sim, 9) DESC, i) <= 5)
"""


@query(f"{BASE}, {VECTORS}, {NEAREST} SELECT i, j, round(sim, 6) AS sim FROM sp")
def semantic_topk(spark, sf_dir):
    ev = pairs.with_text_flag(full_events(spark, sf_dir), SEMANTIC)
    return pairs.semantic_pairs(ev, SEMANTIC).select("i", "j", F.round("sim", 6).alias("sim"))


@query()
def semantic_topk_templates(spark, sf_dir):
    ev = pairs.with_text_flag(full_events(spark, sf_dir), TEMPLATES)
    return pairs.semantic_pairs(ev, TEMPLATES).select("i", "j", F.round("sim", 6).alias("sim"))


# Scores


@query(f"{SCORED} SELECT {PAIR_COLUMNS} FROM pairs")
def scored_pairs(spark, sf_dir):
    return pair_output(pairs.score_pairs(events(spark, sf_dir), PLAIN))


SEM = "CASE WHEN cs.cos >= 0.25e0 THEN (cs.cos - 0.25e0) / 0.75e0 ELSE 0e0 END"
SCORED_SEMANTIC = f"""{BASE}, {CANDIDATES}, {WEIGHTS}, {VECTORS}, {NEAREST}, {scored_sql('UNION ALL SELECT i, j, 0 FROM sp', SEM).replace(
    "JOIN w ON w.resource = a.res", "JOIN w ON w.resource = a.res JOIN (SELECT c.i AS ci, c.j AS cj, CASE WHEN tx.has_text AND ty.has_text THEN list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) END AS cos FROM cand c JOIN vec x ON x.rn = c.i JOIN vec y ON y.rn = c.j JOIN text_of tx ON tx.rn = c.i JOIN text_of ty ON ty.rn = c.j) cs ON cs.ci = i AND cs.cj = j")}"""


@query(f"{SCORED_SEMANTIC} SELECT {PAIR_COLUMNS} FROM pairs")
def scored_pairs_semantic(spark, sf_dir):
    return pair_output(pairs.score_pairs(full_events(spark, sf_dir), SEMANTIC, semantic=True))


@query()
def scored_pairs_semantic_templates(spark, sf_dir):
    return pair_output(pairs.score_pairs(full_events(spark, sf_dir), TEMPLATES, semantic=True))


@query(f"""{SCORED}, h AS (SELECT *, CASE WHEN direct > 0 THEN 0e0 ELSE direct END AS d2 FROM pairs)
SELECT src_event, dst_event, floor((1500 * CAST(round(temporal * 10000) AS BIGINT) + 3000 * CAST(round(semantic * 10000) AS BIGINT) + 2500 * CAST(round(resource * 10000) AS BIGINT) + 1500 * CAST(round(d2 * 10000) AS BIGINT) + 500 * CAST(round(goal * 10000) AS BIGINT) + 1000 * CAST(round(action * 10000) AS BIGINT) + 5000) / 10000) / 10000e0 AS score FROM h
WHERE (semantic > 0 OR resource >= 0.15e0 OR d2 > 0 OR goal > 0) AND floor((1500 * CAST(round(temporal * 10000) AS BIGINT) + 3000 * CAST(round(semantic * 10000) AS BIGINT) + 2500 * CAST(round(resource * 10000) AS BIGINT) + 1500 * CAST(round(d2 * 10000) AS BIGINT) + 500 * CAST(round(goal * 10000) AS BIGINT) + 1000 * CAST(round(action * 10000) AS BIGINT) + 5000) / 10000) / 10000e0 >= 0.12e0""")
def rescored_pairs(spark, sf_dir):
    cut = pairs.score_pairs(events(spark, sf_dir), PLAIN).withColumn("direct", F.lit(0.0))
    return pairs.rescore_pairs(cut, PLAIN).select("src_event", "dst_event", "score")


@query(f"""{SCORED_SEMANTIC}, hit AS (SELECT p.i, p.j, c.rn AS k, c.event_id FROM pairs p JOIN ev a ON a.rn = p.i JOIN ev c ON c.rn < p.i AND a.us - c.us <= 7200000000 AND c.actor_id <> p.src_agent AND c.actor_id <> p.dst_agent
  JOIN said t ON t.rn = c.rn AND t.t <> '' JOIN vec vc ON vc.rn = c.rn JOIN vec va ON va.rn = p.i JOIN vec vb ON vb.rn = p.j
  WHERE p.semantic > 0 AND list_dot_product(CAST(vc.embedding AS DOUBLE[]), CAST(va.embedding AS DOUBLE[])) >= 0.2e0 AND list_dot_product(CAST(vc.embedding AS DOUBLE[]), CAST(vb.embedding AS DOUBLE[])) >= 0.2e0
  QUALIFY row_number() OVER (PARTITION BY p.i, p.j ORDER BY c.rn DESC) <= 3)
SELECT i, j, string_agg(event_id, ',' ORDER BY k) AS common_cause FROM hit GROUP BY i, j""")
def common_cause(spark, sf_dir):
    return causes(spark, sf_dir, SEMANTIC)


def causes(spark, sf_dir, cfg) -> DataFrame:
    """Pairs with common causes; no pair without a semantic component has any, so that only those with one are kept."""
    ev = full_events(spark, sf_dir)
    said = pairs.score_pairs(ev, cfg, semantic=True).where("semantic > 0").select("i", "j", "src_agent", "dst_agent", "semantic")
    found = pairs.common_causes(stored(said, "said-pairs"), ev, cfg)
    return found.where(F.size("common_cause") > 0).select("i", "j", F.array_join("common_cause", ",").alias("common_cause"))


@query()
def common_cause_templates(spark, sf_dir):
    return causes(spark, sf_dir, TEMPLATES)


# Edges

EDGES = f"""{SCORED},
rk AS (SELECT *, row_number() OVER (PARTITION BY src_agent, dst_agent ORDER BY score DESC, j, i) AS nth FROM pairs),
eg AS (SELECT src_agent AS src, dst_agent AS dst, avg(score) FILTER (nth <= 3) AS mean, round(sum(CAST(round(score * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS score, round(sum(CAST(round(temporal * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS temporal, round(sum(CAST(round(semantic * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS semantic,
  round(sum(CAST(round(resource * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS resource, round(sum(CAST(round(direct * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS direct, round(sum(CAST(round(goal * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS goal, round(sum(CAST(round(action * 10000) AS BIGINT)) FILTER (nth <= 3) / count(*) FILTER (nth <= 3)) / 10000e0 AS action,
  count(*) AS support, min(src_us) AS first_us, max(dst_us) AS last_us, median(dt_minutes) AS dt_median, avg(CASE WHEN same_origin IS NULL THEN 0e0 ELSE 1e0 END) FILTER (nth <= 3) >= 0.5e0 AS has_origin,
  coalesce(string_agg(DISTINCT shared_resources, ',' ORDER BY shared_resources) FILTER (shared_resources <> ''), '') AS shared_resources,
  string_agg(src_event || '>' || dst_event, ',' ORDER BY nth) FILTER (nth <= 25) AS evidence
  FROM rk GROUP BY 1, 2 HAVING avg(score) FILTER (nth <= 3) >= 0.15e0),
lv AS (SELECT *, (semantic > 0)::INT + (resource > 0)::INT + (direct > 0)::INT + (goal > 0)::INT AS signals FROM eg),
cf AS (SELECT *, (CASE WHEN mean >= 0.55e0 AND signals >= 2 AND support >= 2 THEN 2 WHEN mean >= 0.45e0 OR (signals >= 2 AND support >= 2) THEN 1 ELSE 0 END) - has_origin::INT AS level FROM lv),
ed AS (SELECT *, CASE WHEN level >= 2 THEN 'strong' WHEN level = 1 THEN 'moderate' ELSE 'weak' END AS confidence FROM cf),
ind AS (SELECT e.src, e.dst, min(ab.dst) AS via FROM ed e JOIN ed ab ON ab.src = e.src AND ab.dst <> e.dst JOIN ed bc ON bc.src = ab.dst AND bc.dst = e.dst
  WHERE e.direct <= 0 AND ab.first_us <= bc.last_us AND least(ab.score, bc.score) >= 0.9e0 * e.score GROUP BY 1, 2),
sib AS (SELECT e.src, e.dst, min(xs.src) AS upstream FROM ed e JOIN ed xs ON xs.dst = e.src AND xs.src <> e.dst AND (xs.direct > 0 OR xs.resource > 0) JOIN ed xd ON xd.src = xs.src AND xd.dst = e.dst AND (xd.direct > 0 OR xd.resource > 0)
  WHERE e.direct <= 0 AND xs.first_us <= e.first_us AND xd.score >= 0.9e0 * e.score GROUP BY 1, 2)
"""


def all_edges(spark, sf_dir) -> DataFrame:
    return stored(edges.collapse(pairs.score_pairs(events(spark, sf_dir), PLAIN), PLAIN), "edges")


@query(f"{EDGES} SELECT src, dst, score, temporal, semantic, resource, direct, goal, action FROM ed")
def edges_topk_mean(spark, sf_dir):
    return all_edges(spark, sf_dir).select("src", "dst", "score", *COMPONENTS)


@query(f"{EDGES} SELECT src, dst, support, first_us, last_us, dt_median, shared_resources, evidence FROM ed")
def edge_stats(spark, sf_dir):
    ev = F.array_join(F.transform("evidence_pairs", lambda e: F.concat_ws(">", e["src_event"], e["dst_event"])), ",").alias("evidence")
    return all_edges(spark, sf_dir).select("src", "dst", "support", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "dt_median", flat("shared_resources"), ev)


@query(f"{EDGES} SELECT src, dst, confidence, (direct = 0 AND resource = 0)::INT + has_origin::INT + (goal > 0)::INT + (dt_median < 2)::INT AS n_alternatives FROM ed")
def edge_confidence(spark, sf_dir):
    return all_edges(spark, sf_dir).select("src", "dst", "confidence", F.size("alternatives").alias("n_alternatives"))


@query(f"{EDGES} SELECT src, dst, via FROM ind")
def edge_indirect(spark, sf_dir):
    return edges.indirect(all_edges(spark, sf_dir)).select("src", "dst", "via")


@query(f"{EDGES} SELECT src, dst, upstream FROM sib")
def edge_sibling(spark, sf_dir):
    return edges.siblings(all_edges(spark, sf_dir)).select("src", "dst", "upstream")


@query(f"{EDGES} SELECT e.src, e.dst, e.score, CASE WHEN i.via IS NULL AND s.upstream IS NULL THEN e.confidence WHEN e.confidence = 'strong' THEN 'moderate' ELSE 'weak' END AS confidence FROM ed e LEFT JOIN ind i USING (src, dst) LEFT JOIN sib s USING (src, dst)")
def influence_edges(spark, sf_dir):
    return edges.mark_indirect(all_edges(spark, sf_dir)).select("src", "dst", "score", "confidence")


@query(f"{EDGES} SELECT 'agent:' || src AS src, 'agent:' || dst AS dst, 'prop:' || src || '->' || dst AS key, 'candidate_propagation' AS rel, score FROM ed WHERE score >= 0.3")
def propagation_graph(spark, sf_dir):
    """The inferred graph of agents above a score, as the observed graph has its edges."""
    from .operators.graph import propagation_edges

    return propagation_edges(all_edges(spark, sf_dir), 0.3)


@query()
def edge_explanations(spark, sf_dir):
    return edges.edges_frame(edges.mark_indirect(all_edges(spark, sf_dir))).drop("scope")


# Segments, components, episodes

SEGMENTS = """seg AS (SELECT rn, event_id, us, sum(new) OVER (ORDER BY rn) AS segment FROM (SELECT rn, event_id, us, CASE WHEN us - lag(us) OVER (ORDER BY rn) > 900000000 THEN 1 ELSE 0 END AS new FROM ev))"""
COMPONENTS_SQL = f"""{SCORED}, {SEGMENTS},
link AS (SELECT i, j FROM pairs JOIN seg a ON a.rn = i JOIN seg b ON b.rn = j WHERE score >= 0.15e0 AND a.segment = b.segment),
both_ways AS (SELECT i, j FROM link UNION SELECT j, i FROM link),
closure(x, y) AS (SELECT i, j FROM both_ways UNION SELECT c.x, l.j FROM closure c JOIN both_ways l ON l.i = c.y),
component AS (SELECT x AS rn, least(x, min(y)) AS component FROM closure GROUP BY x)"""


@query(f"{BASE}, {SEGMENTS} SELECT event_id, CAST(segment AS BIGINT) AS segment FROM seg")
def segments(spark, sf_dir):
    return episodes.segments(events(spark, sf_dir), 15).select("event_id", "segment")


@query(f"{BASE}, {SEGMENTS} SELECT CAST(segment AS BIGINT) AS segment, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM seg GROUP BY 1")
def segment_stats(spark, sf_dir):
    return episodes.segments(events(spark, sf_dir), 15).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"{COMPONENTS_SQL} SELECT rn, component FROM component")
def components(spark, sf_dir):
    ev = events(spark, sf_dir)
    return episodes.strong_components(ev, pairs.score_pairs(ev, PLAIN), EPISODES)


@query(f"""{COMPONENTS_SQL}, grp AS (SELECT component, count(*) AS n_events, count(DISTINCT actor_id) AS n_agents, max(us) - min(us) AS span_us FROM component JOIN ev USING (rn) GROUP BY 1)
SELECT component, n_events, n_agents, span_us FROM grp WHERE n_agents >= 2 AND n_events >= 3""")
def episode_groups(spark, sf_dir):
    return groups(spark, sf_dir, EPISODES)


@query()
def episode_groups_limited(spark, sf_dir):
    return groups(spark, sf_dir, LIMITED)


@query()
def episode_groups_split(spark, sf_dir):
    """With limits that the tables' components exceed, so that they are split by stricter pairs and cut at gaps."""
    return groups(spark, sf_dir, SPLIT)


def groups(spark, sf_dir, cfg) -> DataFrame:
    ev = events(spark, sf_dir)
    m = episodes.episode_members(ev, pairs.score_pairs(ev, PLAIN), cfg)
    return m.groupBy("component").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("actor_id").alias("n_agents"), (F.max("us") - F.min("us")).alias("span_us"))


def found_episodes(spark, sf_dir):
    ev = events(spark, sf_dir)
    scored = stored(pairs.score_pairs(ev, PLAIN), "pairs")
    return ev, scored, episodes.discover(ev, scored, PLAIN, LIMITED)


@query()
def ranked_episodes(spark, sf_dir):
    e = found_episodes(spark, sf_dir)[2]["episodes"]
    return e.select("episode_id", "n_events", "n_agents", "duration_hours", "events_per_hour", "n_candidate_pairs", "n_agent_edges", "n_strong_edges", flat("agents"))


@query()
def detections(spark, sf_dir):
    ev, scored, found = found_episodes(spark, sf_dir)
    found = {k: stored(df, f"found-{k}") for k, df in found.items()}
    return shape.affected(found, detect.run_all(texts_of(spark, sf_dir, found["members"]), scored, found)).withColumns({c: F.array_join(c, ",") for c in ("affected_agents", "affected_resources", "evidence_event_ids")})


# Reachability

KEPT = f"{EDGES}, kp AS (SELECT p.* FROM pairs p JOIN ed ON ed.src = p.src_agent AND ed.dst = p.dst_agent)"
REACH = f"""{KEPT}, walk(source, node, t) AS (SELECT src_agent, dst_agent, dst_us FROM kp UNION SELECT w.source, p.dst_agent, p.dst_us FROM walk w JOIN kp p ON p.src_agent = w.node AND p.src_us >= w.t)"""


def global_kept(spark, sf_dir) -> DataFrame:
    scored = stored(pairs.score_pairs(events(spark, sf_dir), PLAIN), "pairs")
    return stored(reach.kept_pairs(edges.scoped(scored), edges.collapse(scored, PLAIN)), "kept")


@query(f"""{KEPT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY src_agent, dst_agent ORDER BY src_us, src_event, dst_event) AS pos FROM kp),
low AS (SELECT *, min({{'d': dst_us, 'at': -pos}}) OVER (PARTITION BY src_agent, dst_agent ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM numbered)
SELECT l.src_agent AS u, l.dst_agent AS v, l.src_us AS s, l.b.d AS d, x.src_event, x.dst_event FROM low l JOIN numbered x ON x.src_agent = l.src_agent AND x.dst_agent = l.dst_agent AND x.pos = -l.b.at""")
def suffix_min(spark, sf_dir):
    return reach.suffix_minimum(global_kept(spark, sf_dir)).select("u", "v", "s", "d", "src_event", "dst_event")


@query(f"{REACH} SELECT source, node, min(t) AS arrival FROM walk WHERE source <> node GROUP BY 1, 2")
def earliest_arrival(spark, sf_dir):
    return reach.arrivals(global_kept(spark, sf_dir)).select("source", "node", "arrival")


@query(f"{REACH} SELECT DISTINCT source, node AS target FROM walk WHERE source <> node")
def reachable_pairs(spark, sf_dir):
    return reach.reachable_pairs(global_kept(spark, sf_dir)).select("source", "target")


@query()
def propagation_paths(spark, sf_dir):
    hops = F.array_join(F.transform("hops", lambda h: F.concat_ws("→", h["from"], h["to"])), " ")
    return reach.paths(reach.earliest_arrival(global_kept(spark, sf_dir))).select("source", "node", hops.alias("hops"))


@query(f"""{REACH}, n AS (SELECT source, count(DISTINCT node) AS reach FROM walk WHERE source <> node GROUP BY 1), f AS (SELECT a, min(t) AS t FROM (SELECT src_agent AS a, src_us AS t FROM kp UNION ALL SELECT dst_agent, dst_us FROM kp) GROUP BY 1)
SELECT source AS root, reach FROM n JOIN f ON f.a = n.source ORDER BY reach DESC, t, source LIMIT 1""")
def propagation_root(spark, sf_dir):
    kept = global_kept(spark, sf_dir)
    return reach.rooted(kept, reach.reach_counts(kept)).select("root", "reach")


# Detectors


@query(f"""{SCORED}, h AS (SELECT date_trunc('hour', dst_t) AS hour, count(*) AS n, count(DISTINCT src_agent || '>' || dst_agent) AS ap FROM pairs GROUP BY 1)
SELECT CAST(median(n) AS DOUBLE) AS median_pairs, CAST(quantile_cont(n, 0.9) AS DOUBLE) AS p90_pairs, CAST(median(ap) AS DOUBLE) AS median_agent_pairs FROM h""")
def burst_baseline(spark, sf_dir):
    return detect.burst_baseline(pairs.score_pairs(events(spark, sf_dir), PLAIN))


@query(f"""{COMPONENTS_SQL}, big AS (SELECT component FROM component JOIN ev USING (rn) GROUP BY 1 HAVING count(DISTINCT actor_id) >= 2 AND count(*) >= 3), m AS (SELECT component, ev.* FROM component JOIN big USING (component) JOIN ev USING (rn)),
u AS (SELECT component, res, count(DISTINCT actor_id) AS n_agents, count(*) AS n_touches FROM m GROUP BY 1, 2),
s AS (SELECT a.component, shared_resources AS res, count(*) AS supporting_pairs FROM pairs JOIN m a ON a.rn = i JOIN m b ON b.rn = j AND a.component = b.component WHERE shared_resources <> '' GROUP BY 1, 2)
SELECT component AS episode_id, res AS resource, n_agents, n_touches, supporting_pairs FROM u JOIN s USING (component, res) WHERE n_agents >= 2 AND supporting_pairs >= 1""")
def external_channels(spark, sf_dir):
    return channels(spark, sf_dir, EPISODES)


@query()
def external_channels_limited(spark, sf_dir):
    return channels(spark, sf_dir, LIMITED)


def channels(spark, sf_dir, cfg) -> DataFrame:
    ev = events(spark, sf_dir)
    scored = stored(pairs.score_pairs(ev, PLAIN), "pairs")
    m = stored(episodes.episode_members(ev, scored, cfg).withColumnRenamed("component", "episode_id"), "members")
    own = episodes.episode_pairs(m, scored, "episode_id")
    return detect.external_channels(m, own, 2, 1).select("episode_id", "resource", "n_agents", "n_touches", "supporting_pairs")


# Interventions, on the whole table as one scope; ranked for each episode

CONTROLS = f"""{KEPT},
sup AS (SELECT shared_resources AS r, count(*) AS n FROM kp WHERE shared_resources <> '' GROUP BY 1),
stg AS (SELECT src, round(sum(score), 4) AS strength FROM ed GROUP BY 1),
cnd AS (SELECT 'restrict_writes' AS kind, r AS target FROM (SELECT r FROM sup ORDER BY n DESC, r LIMIT 8) UNION ALL SELECT 'approval_gate', '*external*' FROM (SELECT 1 FROM sup LIMIT 1)
  UNION ALL SELECT 'quarantine_agent', src FROM (SELECT src FROM stg ORDER BY strength DESC, src LIMIT 4)
  UNION ALL SELECT 'block_channel', src || '->' || dst FROM (SELECT * FROM ed ORDER BY round(score * support, 4) DESC, src, dst LIMIT 4) WHERE direct > 0 OR semantic > 0
  UNION ALL SELECT 'limit_tool', a || '|' || t FROM (SELECT actor_id AS a, tool AS t, count(*) AS n, min(rn) AS f FROM ev WHERE tool IS NOT NULL AND actor_id IN (SELECT src FROM stg) GROUP BY 1, 2 ORDER BY n DESC, f LIMIT 2))
"""


def controls(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("scope", F.lit(edges.GLOBAL))
    scored = stored(edges.scoped(pairs.score_pairs(ev.drop("scope"), PLAIN)), "pairs")
    e = stored(edges.collapse(scored, PLAIN), "edges")  # controls look at scores and support, not at what else explains an edge
    return ev, scored, e, stored(intervene.generate(scored, e, ev), "controls")


@query(f"{CONTROLS} SELECT kind, target FROM cnd")
def intervention_candidates(spark, sf_dir):
    return controls(spark, sf_dir)[3].select("kind", "target")


@query(f"""{CONTROLS}, x AS (SELECT c.kind, c.target, p.src_event, p.dst_event, CASE WHEN kind = 'block_channel' AND src_agent || '->' || dst_agent = target THEN 0e0 ELSE direct END AS direct,
  CASE WHEN (kind = 'approval_gate' OR (kind = 'restrict_writes' AND shared_resources = target)) AND shared_resources <> '' THEN 0e0 ELSE resource END AS resource
  FROM cnd c, pairs p WHERE NOT coalesce((kind = 'quarantine_agent' AND (src_agent = target OR dst_agent = target)) OR (kind = 'block_channel' AND src_agent || '->' || dst_agent = target AND src_action = 'message') OR (kind = 'limit_tool' AND src_agent || '|' || src_tool = target), FALSE))
SELECT kind, target, count(*) AS n, CAST(sum(CASE WHEN direct > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_direct, CAST(sum(CASE WHEN resource > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_resource FROM x GROUP BY 1, 2""")
def counterfactual_pairs(spark, sf_dir):
    ev, scored, _, c = controls(spark, sf_dir)
    x = intervene.edited_pairs(c, scored, ev)
    return x.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("direct") > 0).cast("long")).alias("n_direct"), F.sum((F.col("resource") > 0).cast("long")).alias("n_resource"))


@query(f"""{CONTROLS}, t AS (SELECT kind, target, event_id FROM cnd, ev WHERE (kind = 'quarantine_agent' AND actor_id = target) OR (kind = 'block_channel' AND action_type = 'message' AND actor_id || '->' || mention = target)
  OR (kind = 'limit_tool' AND actor_id || '|' || tool = target) OR (kind = 'restrict_writes' AND res = target))
SELECT kind, target, count(*) AS n FROM t GROUP BY 1, 2""")
def collateral(spark, sf_dir):
    ev, _, _, c = controls(spark, sf_dir)
    return intervene.touches(c, ev).groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n"))


@query()
def intervention_scores(spark, sf_dir):
    """Controls of every discovered episode; what lies outside is counted from that episode's own events."""
    ev, _, found = found_episodes(spark, sf_dir)
    inside = stored(found["members"].select(F.col("episode_id").alias("scope"), "event_id"), "inside")
    own, e = stored(found["pairs"], "scoped-pairs"), stored(found["edges"], "scoped-edges")
    c = stored(intervene.generate(own, e, inside.join(ev, "event_id")), "controls")
    out = intervene.rank(c, own, e, ev, inside, PLAIN)
    return out.select("scope", "kind", "target", F.round("paths_removed", 6).alias("paths_removed"), "n_paths_before", "n_paths_removed", "collateral_events", F.round("uncertainty", 6).alias("uncertainty"), "score", "confidence", "rank", "label")


# Graph and user-interface queries


@query(f"{BASE}, t AS (SELECT DISTINCT res, actor_id FROM ev WHERE actor_type = 'agent'), g AS (SELECT res FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12) SELECT a.res AS resource, a.actor_id AS a, b.actor_id AS b FROM t a JOIN t b ON a.res = b.res AND a.actor_id < b.actor_id JOIN g ON g.res = a.res")
def resource_share_edges(spark, sf_dir):
    from .operators.graph import share_edges

    return share_edges(events(spark, sf_dir)).select("resource", "a", "b")


@query(f"{BASE} SELECT rel, count(*) AS n FROM (SELECT CASE action_type WHEN 'message' THEN 'sent' END AS rel FROM ev UNION ALL SELECT CASE WHEN mention IS NOT NULL THEN 'received' END FROM ev UNION ALL SELECT CASE WHEN tool IS NOT NULL THEN 'used' END FROM ev UNION ALL SELECT 'referenced' FROM ev) WHERE rel IS NOT NULL GROUP BY 1")
def hetero_edges(spark, sf_dir):
    from .operators.graph import observed_edges

    return observed_edges(events(spark, sf_dir).withColumn("content", F.lit(None).cast("string"))).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT node_type, count(*) AS n FROM (SELECT DISTINCT actor_type AS node_type, actor_id AS id FROM ev UNION SELECT 'agent', mention FROM ev WHERE mention IS NOT NULL UNION SELECT 'message', event_id FROM ev WHERE action_type = 'message' UNION SELECT 'tool', tool FROM ev WHERE tool IS NOT NULL UNION SELECT 'resource', res FROM ev) GROUP BY 1")
def hetero_nodes(spark, sf_dir):
    from .operators.graph import nodes

    return nodes(events(spark, sf_dir).withColumn("content", F.lit(None).cast("string"))).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH u AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '')) AS host, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN host = '' THEN NULL ELSE array_to_string(list_concat([host], parts[1:2]), '/') END AS key FROM u""")
def url_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.resource_key(F.col("url")).alias("key"))


@query(r"""SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1""")
def page_hosts(spark, sf_dir):
    host = text.resource_key(F.col("url"), "domain")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT actor_id, res AS resource, count(*) AS n FROM ev GROUP BY 1, 2")
def who_used_what(spark, sf_dir):
    return events(spark, sf_dir).select("actor_id", F.explode("res").alias("resource")).groupBy("actor_id", "resource").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE}, {SEGMENTS}, f AS (SELECT segment, actor_id, min(ev.rn) AS first_rn FROM seg JOIN ev ON ev.rn = seg.rn GROUP BY 1, 2) SELECT CAST(segment AS BIGINT) AS segment, actor_id, row_number() OVER (PARTITION BY segment ORDER BY first_rn) AS place FROM f")
def arrival_order(spark, sf_dir):
    from pyspark.sql import Window

    ev = events(spark, sf_dir)
    first = episodes.segments(ev, 15).join(ev.select("rn", "actor_id"), "rn").groupBy("segment", "actor_id").agg(F.min("rn").alias("first_rn"))
    return first.select("segment", "actor_id", F.row_number().over(Window.partitionBy("segment").orderBy("first_rn")).cast("long").alias("place"))


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS i, c_custkey * 7 + c_nationkey AS j FROM customer), b AS (SELECT i, j FROM l UNION SELECT j, i FROM l), c(x, y) AS (SELECT i, j FROM b UNION SELECT c.x, b.j FROM c JOIN b ON b.i = c.y)
SELECT x AS vertex, least(x, min(y)) AS component FROM c GROUP BY x""")
def graph_components(spark, sf_dir):
    """Components of a graph in which every customer has a link, by keys as they are."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return connected_components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 7 + F.col("c_nationkey")).alias("b")))


@query(f"{BASE} SELECT a.r AS resource, a.actor_id AS a, b.actor_id AS b FROM (SELECT DISTINCT 'resource:k' || k || '/' || (eid % 97) AS r, actor_id FROM ev WHERE actor_type = 'agent') a JOIN (SELECT DISTINCT 'resource:k' || k || '/' || (eid % 97) AS r, actor_id FROM ev WHERE actor_type = 'agent') b ON a.r = b.r AND a.actor_id < b.actor_id WHERE a.r IN (SELECT 'resource:k' || k || '/' || (eid % 97) FROM ev WHERE actor_type = 'agent' GROUP BY 1 HAVING count(DISTINCT actor_id) BETWEEN 2 AND 12)")
def page_share_edges(spark, sf_dir):
    """Agents that share a page with few others; each resource has 97 pages here."""
    from .operators.graph import share_edges

    page = F.transform("res", lambda r: F.concat(r, F.lit("/"), (F.col("event_id").cast("long") % 97).cast("string")))
    return share_edges(events(spark, sf_dir).withColumn("res", page)).select("resource", "a", "b")


# Words


@query(r"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), t AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 20000),
x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n) SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x""".replace("\\\\", "\\"))
def tfidf_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return labels.tfidf(docs, id_column="doc_id", stop=()).withColumn("weight", F.round("weight", 6))


@query(r"""WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings) SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first, round(CAST(embedding[2] AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS second FROM v""")
def unit_vectors(spark, sf_dir):
    v = labels.normalised(F.col("embedding"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(1)), 6).alias("second"))


@query(r"""SELECT md5(t) AS text_md5, count(DISTINCT source) AS posters FROM (SELECT source, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM documents) WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 3""")
def template_texts(spark, sf_dir):
    """Texts that three or more sources posted: what the template rule leaves out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("content"), F.col("source").alias("actor_id"))
    flagged = pairs.with_text_flag(docs, PairConfig()).withColumn("t", F.lower(F.trim(F.regexp_replace("content", r"\s+", " "))))
    return flagged.where("not has_text and t <> ''").groupBy(F.md5("t").alias("text_md5")).agg(F.count_distinct("actor_id").alias("posters"))


@query(rf"""WITH w AS (SELECT unnest(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '{labels.TOKEN.replace("'", "''")}'), lambda t: NOT contains(t, '://')), lambda t: lower(t)))) AS word FROM documents),
often AS (SELECT word FROM w GROUP BY 1 HAVING count(*) / (SELECT greatest(1, count(*)) FROM documents) > 0.015::DOUBLE)
SELECT word FROM often UNION SELECT unnest(list_filter(string_split_regex(lower(replace(source, '@', ' ')), '\s+'), lambda p: p <> '')) AS word FROM documents""")
def common_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return labels.common_words(docs.select(F.col("text").alias("content"), F.col("source").alias("actor_id")))


@query()
def source_labels(spark, sf_dir):
    """What sets each source's words off from the others'."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return labels.group_labels(docs, key="source").withColumn("terms", F.array_join("terms", ","))


#: Stop words of the query that SQL follows: its text is made without a session, and so without Spark's own list.
STOP = ("and", "are", "for", "from", "has", "have", "not", "that", "the", "this", "was", "were", "with")


@query(rf"""WITH s AS (SELECT source AS id, list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F\P{{L}}]', 'Z', 'g'), '\b[a-z][a-z0-9_\-]{{2,}}\b'), lambda w: w NOT IN {STOP}) AS w FROM documents),
g AS (SELECT id, unnest(w) AS term FROM s UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM s),
t AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(DISTINCT source) AS n FROM documents),
d AS (SELECT term, count(*) AS df, any_value(n) AS n FROM t, n GROUP BY 1 HAVING any_value(n) <= 3 OR count(*) <= 0.8::DOUBLE * any_value(n) ORDER BY sum(tf) DESC, term LIMIT 20000),
x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term)), y AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x),
p AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, term) AS place FROM y QUALIFY place <= 12), l AS (SELECT id, list([term] ORDER BY place) AS f FROM p GROUP BY 1)
SELECT source, coalesce(array_to_string(list_reduce(f, lambda a, x: CASE WHEN len(a) < 4 AND len(list_filter(a, lambda o: contains(o, x[1]) OR contains(x[1], o))) = 0 THEN a || x ELSE a END), ','), '') AS terms
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN l ON l.id = source""")
def source_terms(spark, sf_dir):
    """:func:`source_labels` with a list of stop words of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return labels.group_labels(docs, key="source", stop=STOP).withColumn("terms", F.array_join("terms", ","))


# Measures and shapes


@query(f"""{EDGES} SELECT count(*) AS n_edges, round(avg((e.resource > 0)::INT), 9) AS via_page, round(avg((e.direct > 0)::INT), 9) AS replies,
  round(avg((CASE WHEN i.via IS NULL AND s.upstream IS NULL THEN e.confidence WHEN e.confidence = 'strong' THEN 'moderate' ELSE 'weak' END <> 'weak')::INT), 9) AS supported,
  round(avg((e.has_origin OR i.via IS NOT NULL OR s.upstream IS NOT NULL)::INT), 9) AS contested FROM ed e LEFT JOIN ind i USING (src, dst) LEFT JOIN sib s USING (src, dst)""")
def edge_shares(spark, sf_dir):
    found = shape.edge_shares(edges.mark_indirect(all_edges(spark, sf_dir)))
    return found.select("n_edges", *[F.round(c, 9).alias(c) for c in ("via_page", "replies", "supported", "contested")])


@query(f"""{EDGES}, fin AS (SELECT CASE WHEN i.via IS NULL AND s.upstream IS NULL THEN e.confidence WHEN e.confidence = 'strong' THEN 'moderate' ELSE 'weak' END AS c FROM ed e LEFT JOIN ind i USING (src, dst) LEFT JOIN sib s USING (src, dst))
SELECT n_events, n_agents, first_us, last_us, count(c) AS n_edges, count(*) FILTER (c = 'strong') AS strong, count(*) FILTER (c = 'moderate') AS moderate, count(*) FILTER (c = 'weak') AS weak
FROM fin, (SELECT count(*) AS n_events, count(DISTINCT actor_id) FILTER (actor_type = 'agent') AS n_agents, min(us) AS first_us, max(us) AS last_us FROM ev) GROUP BY ALL""")
def summary(spark, sf_dir):
    s = shape.summary(events(spark, sf_dir), edges.mark_indirect(all_edges(spark, sf_dir)))
    return s.select("n_events", "n_agents", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_edges", "strong", "moderate", "weak")


@query(f"{BASE} SELECT actor_id, action_type FROM (SELECT actor_id, action_type, count(*) AS n, min(rn) AS f FROM ev GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY n DESC, f) = 1")
def usual_action(spark, sf_dir):
    return shape.mode(events(spark, sf_dir), "actor_id", "action_type")


@query(f"{SCORED} SELECT row_number() OVER (ORDER BY score DESC, j, i) AS place, dst_event AS event_id, score FROM pairs ORDER BY place LIMIT 10")
def top_evidence(spark, sf_dir):
    scored = edges.scoped(pairs.score_pairs(events(spark, sf_dir), PLAIN))
    return shape.top_evidence(scored).select(F.col("place").cast("long").alias("place"), "event_id", "score")


def segment_members(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    return episodes.segments(ev, 15).select("rn", F.col("segment").alias("episode_id")).join(ev.drop("segment"), "rn")


@query(f"""{BASE}, {SEGMENTS}, t AS (SELECT segment, actor_id, res, count(*) AS n, min(ev.rn) AS f FROM seg JOIN ev ON ev.rn = seg.rn GROUP BY 1, 2, 3), u AS (SELECT segment, res, count(*) AS a, min(f) AS f FROM t GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY a DESC, f, res) AS place, max(a) OVER (PARTITION BY segment) >= 2 AS shared FROM u)
SELECT CAST(segment AS BIGINT) AS episode_id, actor_id, res AS resource, n FROM t JOIN p USING (segment, res) WHERE CASE WHEN shared THEN p.a >= 2 AND place <= 8 ELSE place <= 3 END""")
def who_used_most(spark, sf_dir):
    return shape.who_used_what(segment_members(spark, sf_dir))


@query(f"""{BASE}, {SEGMENTS} SELECT CAST(segment AS BIGINT) AS episode_id, round(count(*) FILTER (k < 50) / (count(*) + (SELECT count(*) FROM ev WHERE k < 50) - count(*) FILTER (k < 50)), 9) AS jaccard FROM seg JOIN ev ON ev.rn = seg.rn GROUP BY 1""")
def event_set_jaccard(spark, sf_dir):
    ev = events(spark, sf_dir)
    truth = ev.where(F.regexp_extract(F.get("res", F.lit(0)), r"(\d+)", 1).cast("int") < 50).select("event_id")
    return analysis.event_set_jaccard(segment_members(spark, sf_dir), truth).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""{EDGES}, tr AS (SELECT DISTINCT a.actor_id AS src, b.actor_id AS dst FROM reply JOIN ev a ON a.rn = i JOIN ev b ON b.rn = j), h AS (SELECT count(*) AS n, count(tr.src) AS hits FROM ed LEFT JOIN tr ON tr.src = ed.src AND tr.dst = ed.dst)
SELECT round(CASE WHEN n = 0 THEN 0 ELSE hits / n END, 9) AS precision, round(hits / (SELECT count(*) FROM tr), 9) AS recall FROM h""")
def edge_quality(spark, sf_dir):
    """The edges against who answered whom."""
    ev = events(spark, sf_dir)
    who = lambda c, name: ev.select(F.col("rn").alias(c), F.col("actor_id").alias(name))
    truth = pairs.reply_pairs(ev, PLAIN).join(who("i", "src"), "i").join(who("j", "dst"), "j").select("src", "dst").distinct()
    return analysis.edge_quality(all_edges(spark, sf_dir), truth).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall")])


def order_events(spark, sf_dir) -> DataFrame:
    """Orders as pages: each line item writes one when it is shipped, and deletes it up to two months later."""
    ship = F.to_date("l_shipdate")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"l_shipdate": ship, "l_receiptdate": F.date_add(ship, (F.col("l_partkey") % 60).cast("int"))})
    page = F.concat(F.lit("wiki:"), F.col("l_orderkey").cast("string")).alias("target_id")
    who = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("actor_id")
    of = lambda at, action, kind: line.select(F.col(at).cast("timestamp").alias("timestamp"), page, F.lit(action).alias("action_type"), F.lit(kind).alias("actor_type"), who, F.lit(None).cast("string").alias("recreation_of"), F.concat_ws(":", F.lit(action), "l_orderkey", "l_linenumber").alias("event_id"), "l_returnflag", "l_linestatus")
    return of("l_shipdate", "edit", "agent").unionByName(of("l_receiptdate", "delete", "human"))


LINES = "lines AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, CAST(l_shipdate AS DATE) + CAST(l_partkey % 60 AS INTEGER) AS l_receiptdate FROM lineitem)"


@query(f"""WITH {LINES}, g AS (SELECT l_orderkey, min(l_receiptdate) AS gone FROM lines GROUP BY 1), l AS (SELECT l_orderkey, date_diff('day', max(l_shipdate), any_value(gone)) AS days FROM lines JOIN g USING (l_orderkey) WHERE l_shipdate <= gone GROUP BY 1)
SELECT least(days, 30) AS lag_days, count(*) AS n, (SELECT median(days * 24.0) FROM l) AS median_hours FROM l GROUP BY 1""")
def deletion_lags(spark, sf_dir):
    return shape.deletion_lags(order_events(spark, sf_dir)).withColumn("lag_days", F.col("lag_days").cast("long"))


@query(f"""WITH {LINES} SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(*) FILTER (w) AS writes, count(*) FILTER (NOT w) AS deletions FROM (SELECT l_shipdate AS d, TRUE AS w FROM lines UNION ALL SELECT l_receiptdate, FALSE FROM lines) GROUP BY 1""")
def daily_writes(spark, sf_dir):
    return shape.daily_writes(order_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("""WITH lines AS (SELECT l_orderkey AS p, CAST(l_shipdate AS DATE) AS d, CAST(l_shipdate AS DATE) + CAST(l_partkey % 60 AS INTEGER) AS del, 's' || l_suppkey AS who, l_returnflag = 'R' AS gives_up, l_linestatus = 'O' AS again FROM lineitem),
pg AS (SELECT DISTINCT p, date_trunc('month', d) AS e FROM lines), en AS (SELECT date_trunc('month', d) AS e, max(d) AS ending FROM lines GROUP BY 1), g AS (SELECT p, min(del) AS gone FROM lines WHERE gives_up GROUP BY 1),
a AS (SELECT e, count(*) AS episode_pages, count(gone) AS pages_deleted, CAST(round(date_diff('hour', max(ending), min(gone)), 1) AS DOUBLE) AS hours_to_first_deletion FROM pg JOIN en USING (e) LEFT JOIN g USING (p) GROUP BY 1),
w AS (SELECT e, count(*) FILTER (again) AS recreations, count(*) FILTER (d > ending AND d < gone) AS writes_before_deletion, count(*) FILTER (d > ending AND gone IS NULL) AS writes_on_kept_pages FROM pg JOIN en USING (e) JOIN lines USING (p) LEFT JOIN g USING (p) GROUP BY 1),
b AS (SELECT e, string_agg(DISTINCT who, ',' ORDER BY who) AS deleted_by FROM pg JOIN lines USING (p) WHERE gives_up GROUP BY 1)
SELECT CAST(CAST(e AS DATE) AS VARCHAR) AS episode_id, episode_pages, pages_deleted, hours_to_first_deletion, recreations, writes_before_deletion, writes_on_kept_pages, coalesce(deleted_by, '') AS deleted_by,
  (SELECT round(count(gone) / count(*), 3) FROM (SELECT DISTINCT p FROM lines) LEFT JOIN g USING (p)) AS deletion_base_rate FROM a JOIN w USING (e) LEFT JOIN b USING (e)""")
def historical_audit(spark, sf_dir):
    """What became of the pages of each month's writes: returned lines delete their page, open ones write it anew."""
    ev = order_events(spark, sf_dir).where("action_type <> 'delete' or l_returnflag = 'R'")
    anew = (F.col("action_type") == "edit") & (F.col("l_linestatus") == "O")
    ev = ev.withColumn("recreation_of", F.when(anew, F.col("target_id"))).withColumn("action_type", F.when(anew, "create").otherwise(F.col("action_type")))
    month = F.to_date(F.date_trunc("month", "timestamp")).cast("string").alias("episode_id")
    members = ev.where("action_type <> 'delete'").select(month, "event_id", "timestamp")
    ends = members.groupBy("episode_id").agg(F.max("timestamp").alias("end"))
    found = intervene.historical_response(members.drop("timestamp"), ends, ev)
    whole = [F.col(c).cast("long").alias(c) for c in ("episode_pages", "pages_deleted", "recreations", "writes_before_deletion", "writes_on_kept_pages")]
    return found.select("episode_id", *whole, F.col("hours_to_first_deletion").cast("double").alias("hours_to_first_deletion"), F.array_join("deleted_by", ",").alias("deleted_by"), "deletion_base_rate")


@query()
def episode_shape(spark, sf_dir):
    ev, scored, found = found_episodes(spark, sf_dir)
    found = {k: stored(df, f"found-{k}") for k, df in found.items()}
    return shape.episode_shape(found, detect.run_all(texts_of(spark, sf_dir, found["members"]), scored, found))


@query()
def episode_sentences(spark, sf_dir):
    ev, _, found = found_episodes(spark, sf_dir)
    return shape.summaries(found, ev)

