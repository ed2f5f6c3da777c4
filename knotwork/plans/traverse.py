"""Queries of path search, evidence and context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import kg, traverse
from knotwork.plans.retrieval import dense_scores
from knotwork.plans.sqlparts import EDGES, MEM
from knotwork.plans.retrieval import DEN, _top, hashed
from knotwork.plans.text import _LIT, PREMISES, _asc, _in, _tok
from knotwork.sources import table

QUERIES, SQL = {}, {}
BOUNDS = traverse.Bounds()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def seeds(spark, d):
    return table(spark, d, "test_items").select(F.col("item_id").alias("qid"), F.explode(T.literal_list(F.col("q_entity"))).alias("id"))


def questions(spark, d):
    return table(spark, d, "test_items").where("question is not null").select(F.col("item_id").alias("qid"), "question")


SEEDS = f"sd AS (SELECT DISTINCT item_id AS qid, id FROM (SELECT item_id, unnest({_LIT.format(c='q_entity')}) AS id FROM test_items))"


@query(f"WITH {EDGES}, {SEEDS} SELECT s.qid, e.src, e.rel, e.dst FROM sd s JOIN edg e ON e.src = s.id")
def neighbors(spark, d):
    return seeds(spark, d).distinct().join(kg.edges(spark, d), F.col("id") == F.col("src")).select("qid", "src", "rel", "dst")


@query(f"WITH {EDGES}, {SEEDS}, {MEM}, {DEN}, t AS ({_top('den', 20)}), c AS (SELECT DISTINCT s.qid, e.src, e.rel, e.dst, m.pid FROM sd s JOIN edg e ON e.src = s.id JOIN mem m ON m.id = e.dst JOIN t ON t.qid = s.qid AND t.id = m.pid) SELECT qid, src, rel, dst, pid, nth FROM (SELECT *, row_number() OVER (PARTITION BY qid, src ORDER BY dst, rel) AS nth FROM c) WHERE nth <= 100")
def neighbors_topk_scoped(spark, d):
    """Outgoing edges whose target lies in one of the question's twenty best partitions."""
    scope = dense_scores(spark, d, keep=20).select("qid", F.col("id").cast("int").alias("pid"))
    met = seeds(spark, d).distinct().join(kg.edges(spark, d), F.col("id") == F.col("src")).join(kg.members(spark, d).withColumnRenamed("id", "dst"), "dst").join(scope, ["qid", "pid"])
    order = Window.partitionBy("qid", "src").orderBy("dst", "rel")
    return met.select("qid", "src", "rel", "dst", "pid").withColumn("nth", F.row_number().over(order)).where("nth <= 100")


@query(f"WITH {EDGES}, {SEEDS}, {MEM}, b AS (SELECT s.qid, e.rel, e.dst AS other FROM sd s JOIN edg e ON e.src = s.id UNION SELECT s.qid, e.rel, e.src FROM sd s JOIN edg e ON e.dst = s.id) SELECT DISTINCT b.qid, r.rel_name, m.pid FROM b JOIN rl r ON r.rel = b.rel JOIN mem m ON m.id = b.other")
def bridge_partitions(spark, d):
    """Relation names and partitions one undirected step away from the seeds."""
    s, e = seeds(spark, d).distinct(), kg.edges(spark, d)
    ahead = s.join(e, F.col("id") == F.col("src")).select("qid", "rel", F.col("dst").alias("other"))
    back = s.join(e, F.col("id") == F.col("dst")).select("qid", "rel", F.col("src").alias("other"))
    return ahead.unionByName(back).join(kg.relations(spark, d), "rel").join(kg.members(spark, d).withColumnRenamed("id", "other"), "other").select("qid", "rel_name", "pid").distinct()


def _arr(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _intent(tokens: str, with_name: bool) -> str:
    parts = []
    for name, terms in traverse.INTENTS.items():
        words = dict.fromkeys([w for t in terms for w in t.split("-")] + ([w for w in name.split() if w not in T.STOP_WORDS and w != "in"] if with_name else []))
        parts.append(f"WHEN list_has_any({tokens}, {_arr(words)}) THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


def _content(c: str) -> str:
    return f"list_filter({_asc(c)}, lambda t: t NOT IN {_in(T.STOP_WORDS)})"


@query(f"WITH rl AS (SELECT DISTINCT lower(trim(relation_name)) AS r FROM relations WHERE relation_name IS NOT NULL), x AS (SELECT t.item_id AS qid, rl.r, {_content('rl.r')} AS rt, {_content('t.question')} AS qt FROM test_items t, rl WHERE t.question IS NOT NULL), y AS (SELECT *, {_intent('rt', True)} AS ri, {_intent('qt', False)} AS qi FROM x) SELECT qid, r AS relation, CASE WHEN CASE WHEN ri IS NOT NULL AND qi IS NOT NULL THEN ri = qi ELSE list_has_any(rt, qt) END THEN 1.0::DOUBLE WHEN list_has_any(rt, {_arr(traverse.STRUCTURAL_TERMS)}) THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS relevance FROM y")
def relation_relevance(spark, d):
    """Every question against every relation name (a fixed list of relations)."""
    rels = kg.relations(spark, d).where("rel_name <> ''").select(F.col("rel_name").alias("relation")).distinct()
    names = rels.agg(F.sort_array(F.collect_set("relation")).alias("names"))
    q = questions(spark, d).crossJoin(names).select("qid", "question", F.explode("names").alias("relation"))  # one row of names
    return q.select("qid", "relation", traverse.relation_relevance(F.col("relation"), F.col("question")).alias("relevance"))


def _hop(n: int) -> str:
    """CTEs of hop ``n`` from beam ``b{n-1}`` to beam ``b{n}``."""
    p = n - 1
    return f"""c{n} AS (SELECT * FROM (SELECT b.*, e.src, e.rel, e.dst, row_number() OVER (PARTITION BY b.state ORDER BY e.dst, e.rel) AS nth FROM b{p} b JOIN edg e ON e.src = b.node WHERE NOT list_contains(b.visited, e.dst)) WHERE nth <= 100),
x{n} AS (SELECT c.*, c.src || '|' || c.rel || '|' || c.dst AS edge, r.rel_name, s.name || ' ' || r.rel_name || ' ' || t.name || ' ' || t.descr AS txt, q.question FROM c{n} c JOIN rl r ON r.rel = c.rel JOIN ent s ON s.id = c.src JOIN ent t ON t.id = c.dst JOIN test_items q ON q.item_id = c.qid AND q.question IS NOT NULL),
k{n} AS (SELECT qid, state, edge, unnest({_content('txt')}) AS token FROM x{n}), f{n} AS (SELECT qid, state, edge, token, count(*) AS tf FROM k{n} GROUP BY ALL), l{n} AS (SELECT state, edge, sum(tf) AS dl FROM f{n} GROUP BY ALL),
z{n} AS (SELECT x.state, count(*) AS n, avg(coalesce(l.dl, 0)) AS avg_dl FROM x{n} x LEFT JOIN l{n} l ON l.state = x.state AND l.edge = x.edge GROUP BY x.state), d{n} AS (SELECT state, token, count(*) AS df FROM f{n} GROUP BY ALL),
m{n} AS (SELECT f.state, f.edge, round(sum(ln(1 + (z.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * f.tf * 2.5::DOUBLE / (f.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / z.avg_dl))), 9) AS lexical FROM f{n} f JOIN qc ON qc.qid = f.qid AND qc.token = f.token JOIN d{n} d ON d.state = f.state AND d.token = f.token JOIN l{n} l ON l.state = f.state AND l.edge = f.edge JOIN z{n} z ON z.state = f.state GROUP BY ALL),
et{n} AS (SELECT DISTINCT edge, txt FROM x{n}), eo{n} AS (SELECT edge, unnest({_tok('txt')}) AS token FROM et{n}), eh{n} AS {hashed(f'eo{n}', 'edge')},
g{n} AS (SELECT x.state, x.edge, round(sum(h.val * q.val), 9) AS dense FROM x{n} x JOIN eh{n} h ON h.edge = x.edge JOIN qv q ON q.qid = x.qid AND q.dim = h.dim GROUP BY ALL),
s{n} AS (SELECT x.*, coalesce(m.lexical, 0) AS lexical, coalesce(g.dense, 0) AS dense, {_content('x.rel_name')} AS rt, {_content('x.question')} AS qt FROM x{n} x LEFT JOIN m{n} m ON m.state = x.state AND m.edge = x.edge LEFT JOIN g{n} g ON g.state = x.state AND g.edge = x.edge),
i{n} AS (SELECT *, {_intent('rt', True)} AS ri, {_intent('qt', False)} AS qi FROM s{n}),
v{n} AS (SELECT *, CASE WHEN CASE WHEN ri IS NOT NULL AND qi IS NOT NULL THEN ri = qi ELSE list_has_any(rt, qt) END THEN 1.0::DOUBLE WHEN list_has_any(rt, {_arr(traverse.STRUCTURAL_TERMS)}) THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS relevance, min(dense) OVER w AS d0, max(dense) OVER w AS d1, min(lexical) OVER w AS l0, max(lexical) OVER w AS l1 FROM i{n} WINDOW w AS (PARTITION BY state)),
e{n} AS (SELECT *, round(0.35::DOUBLE * CASE WHEN d1 = d0 THEN 0 ELSE (dense - d0) / (d1 - d0) END + 0.35::DOUBLE * CASE WHEN l1 = l0 THEN 0 ELSE (lexical - l0) / (l1 - l0) END + 0.2::DOUBLE * relevance, 9) AS edge_score FROM v{n}),
b{n} AS (SELECT qid, state, node, visited, rels, score, hop FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, state) AS nth FROM (SELECT qid, state || ';' || edge AS state, dst AS node, list_append(visited, dst) AS visited, list_append(rels, rel) AS rels, round(score + edge_score + CASE WHEN list_contains(rels, rel) THEN 0 ELSE 0.1::DOUBLE END - 0.05::DOUBLE, 9) AS score, hop + 1 AS hop FROM e{n})) WHERE nth <= {BOUNDS.beam})"""


_BEAM = f"{EDGES}, {SEEDS}, qa AS (SELECT item_id AS qid, unnest({_tok('question')}) AS token FROM test_items WHERE question IS NOT NULL), qv AS {hashed('qa', 'qid')}, qc AS (SELECT DISTINCT qid, token FROM (SELECT item_id AS qid, unnest({_content('question')}) AS token FROM test_items WHERE question IS NOT NULL)), b0 AS (SELECT qid, qid || ':' || id AS state, id AS node, [id] AS visited, []::VARCHAR[] AS rels, 0.0::DOUBLE AS score, 0 AS hop FROM sd)"


def _search_parts(spark, d):
    names = kg.entities(spark, d).select("id", "name", "descr")
    return kg.edges(spark, d), names, kg.relations(spark, d), questions(spark, d)


@query(f"WITH {_BEAM}, {_hop(1)} SELECT qid, edge, round(dense, 6) AS dense, round(lexical, 6) AS lexical, relevance, round(edge_score, 6) AS edge_score FROM e1")
def edge_scores(spark, d):
    edges, names, rels, qs = _search_parts(spark, d)
    beam = traverse.start(seeds(spark, d))
    cands = traverse.neighbours(beam.select("state", "node", "visited"), edges, BOUNDS.neighbours).join(beam.select("qid", "state"), "state")
    cands = cands.join(rels, "rel", "left").join(names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), "descr"), "dst", "left")
    cands = cands.select("qid", "state", F.concat_ws("|", "src", "rel", "dst").alias("edge"), F.coalesce("rel_name", "rel").alias("relation"), F.concat_ws(" ", "src_name", "rel_name", "dst_name", "descr").alias("text"))
    s = traverse.edge_scores(cands, qs, BOUNDS)
    return s.select("qid", "edge", F.round("dense", 6).alias("dense"), F.round("lexical", 6).alias("lexical"), "relevance", F.round("edge_score", 6).alias("edge_score"))


def _paths(n_hops: int) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM b{n}" for n in range(1, n_hops + 1))
    hops = ", ".join(_hop(n) for n in range(1, n_hops + 1))
    return f"{_BEAM}, {hops}, pa AS (SELECT qid, state, node, score, hop, row_number() OVER (PARTITION BY qid ORDER BY score DESC, state) AS rank FROM ({union})), pk AS (SELECT * FROM pa WHERE rank <= {BOUNDS.paths})"


def _searched(spark, d, hops):
    edges, names, rels, qs = _search_parts(spark, d)
    return traverse.search(seeds(spark, d), edges, names, rels, qs, traverse.Bounds(hops=hops))


@query(f"WITH {_paths(1)} SELECT qid, state, node, round(score, 6) AS score, rank FROM pk")
def beam_1hop(spark, d):
    return _searched(spark, d, 1).select("qid", "state", "node", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_paths(2)} SELECT qid, state, node, round(score, 6) AS score, CAST(hop AS BIGINT) AS hop, rank FROM pk")
def beam_2hop(spark, d):
    return _searched(spark, d, 2).select("qid", "state", "node", F.round("score", 6).alias("score"), F.col("hop").cast("bigint").alias("hop"), "rank")


@query(f"WITH {_paths(1)}, p AS (SELECT qid, split_part(split_part(state, ';', 1), ':', 2) AS seed, state, score FROM b1), n AS (SELECT qid, count(DISTINCT seed) AS k FROM p GROUP BY qid), m AS (SELECT p.*, row_number() OVER (PARTITION BY p.qid, seed ORDER BY score DESC, state) <= greatest(1, floor(3 / k)) AS first FROM p JOIN n ON n.qid = p.qid) SELECT qid, seed, state, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first DESC, score DESC, state) AS rank FROM m) WHERE rank <= 3")
def fair_share_paths(spark, d):
    edges, names, rels, qs = _search_parts(spark, d)
    beam = traverse.hop(traverse.start(seeds(spark, d)), edges, names, rels, qs, BOUNDS)
    paths = beam.select("qid", F.split_part(F.split_part("state", F.lit(";"), F.lit(1)), F.lit(":"), F.lit(2)).alias("seed"), "state", "score")
    return traverse.fair_share(paths, 3).select("qid", "seed", "state", F.round("score", 6).alias("score"), "rank")


_EVID = f"{EDGES}, {SEEDS}, h1 AS (SELECT DISTINCT s.qid, e.src, e.rel, e.dst, 1 AS hop FROM sd s JOIN edg e ON e.src = s.id), h2 AS (SELECT DISTINCT h.qid, e.src, e.rel, e.dst, 2 AS hop FROM (SELECT DISTINCT qid, dst FROM h1) h JOIN edg e ON e.src = h.dst), fa AS (SELECT qid, src, rel, dst, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY qid, src, rel, dst), ra AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, src, rel, dst) AS rank FROM fa)"


def evidence(spark, d):
    """``qid, src, rel, dst, hop, rank``: facts within two hops of the topic, nearest first, at most 200."""
    e = kg.edges(spark, d)
    one = seeds(spark, d).distinct().join(e, F.col("id") == F.col("src")).select("qid", "src", "rel", "dst").distinct().withColumn("hop", F.lit(1))
    two = one.select("qid", F.col("dst").alias("via")).distinct().join(e, F.col("via") == F.col("src")).select("qid", "src", "rel", "dst").withColumn("hop", F.lit(2))
    facts = one.unionByName(two).groupBy("qid", "src", "rel", "dst").agg(F.min("hop").alias("hop"))
    return facts.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("hop", "src", "rel", "dst"))).where("rank <= 200")


@query(f"WITH {_EVID} SELECT qid, src, rel, dst, CAST(hop AS BIGINT) AS hop, rank FROM ra WHERE rank <= 200")
def budgeted_evidence(spark, d):
    return evidence(spark, d).withColumn("hop", F.col("hop").cast("bigint"))


@query(f"WITH {_EVID}, pm AS (SELECT DISTINCT item_id AS qid, premise FROM ({PREMISES})), j AS (SELECT p.qid, p.premise, r.rank FROM pm p LEFT JOIN ra r ON r.qid = p.qid AND r.rank <= 200 AND r.src || '|' || r.rel || '|' || r.dst = p.premise) SELECT k AS budget, count(*) AS n, round(avg(rec), 6) AS recall, round(avg(CASE WHEN rec = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM (SELECT k, qid, count(*) FILTER (rank <= k)::DOUBLE / count(*) AS rec FROM j, (SELECT unnest([10, 20, 50, 100, 200]) AS k) b GROUP BY ALL) GROUP BY k")
def evidence_budget_sweep(spark, d):
    gold = table(spark, d, "test_items").select(F.col("item_id").alias("qid"), F.explode(T.premises(F.col("grounding"))).alias("premise")).distinct()
    found = evidence(spark, d).select("qid", F.concat_ws("|", "src", "rel", "dst").alias("premise"), "rank")
    j = gold.join(found, ["qid", "premise"], "left").withColumn("budget", F.explode(F.array(*map(F.lit, (10, 20, 50, 100, 200)))))
    per = j.groupBy("budget", "qid").agg((F.count_if(F.col("rank") <= F.col("budget")) / F.count(F.lit(1))).alias("rec"))
    return per.groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rec"), 6).alias("recall"), F.round(F.avg((F.col("rec") == 1).cast("double")), 6).alias("coverage"))


@query(f"""WITH {_paths(1)}, ln AS (SELECT p.qid, p.rank, p.score, string_split(split_part(p.state, ';', 2), '|') AS e FROM pk p)
SELECT ln.qid, string_agg('Path ' || rank || ': [P' || rank || '.E1] ' || s.name || ' (' || e[1] || ') --' || r.rel_name || ' (' || e[2] || ')--> ' || t.name || ' (' || e[3] || ').' || CASE WHEN t.descr <> '' THEN ' Target description: ' || rtrim(substr(trim(regexp_replace(t.descr, '\\s+', ' ', 'g')), 1, 240)) ELSE '' END, chr(10) ORDER BY rank) AS context FROM ln JOIN ent s ON s.id = e[1] JOIN rl r ON r.rel = e[2] JOIN ent t ON t.id = e[3] GROUP BY ln.qid""")
def evidence_context(spark, d):
    """The citation-labelled lines of each question's best paths."""
    edges, names, rels, qs = _search_parts(spark, d)
    p = _searched(spark, d, 1).select("qid", "rank", F.split(F.split_part("state", F.lit(";"), F.lit(2)), r"\|").alias("e"))
    p = p.select("qid", "rank", F.col("e")[0].alias("src"), F.col("e")[1].alias("rel"), F.col("e")[2].alias("dst"))
    n = p.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(rels, "rel").join(names.select(F.col("id").alias("dst"), F.col("name").alias("t"), "descr"), "dst")
    line = F.concat(F.format_string("Path %d: [P%d.E1] %s (%s) --%s (%s)--> %s (%s).", "rank", "rank", "s", "src", "rel_name", "rel", "t", "dst"), F.when(F.col("descr") != "", F.concat(F.lit(" Target description: "), T.shorten(F.col("descr"), 240))).otherwise(""))
    lines = n.select("qid", F.struct("rank", line.alias("line")).alias("x")).groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lines.select("qid", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("context"))


@query(f"WITH {_paths(1)}, ln AS (SELECT qid, string_split(split_part(state, ';', 2), '|') AS e FROM pk WHERE rank = 1) SELECT ln.qid, e[3] AS answer_id, s.name || ' ' || r.rel_name || ' ' || t.name || '. [P1.E1]' AS answer FROM ln JOIN ent s ON s.id = e[1] JOIN rl r ON r.rel = e[2] JOIN ent t ON t.id = e[3]")
def direct_answer(spark, d):
    """A sentence from the best path of each question; questions without a path get none."""
    edges, names, rels, qs = _search_parts(spark, d)
    p = _searched(spark, d, 1).where("rank = 1").select("qid", F.split(F.split_part("state", F.lit(";"), F.lit(2)), r"\|").alias("e"))
    p = p.select("qid", F.col("e")[0].alias("src"), F.col("e")[1].alias("rel"), F.col("e")[2].alias("answer_id"))
    n = p.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(rels, "rel").join(names.select(F.col("id").alias("answer_id"), F.col("name").alias("t")), "answer_id")
    return n.select("qid", "answer_id", F.concat("s", F.lit(" "), "rel_name", F.lit(" "), "t", F.lit(". [P1.E1]")).alias("answer"))


@query()
def adaptive_paths(spark, d):
    """The best paths of each question within its own hops, beam width and path count."""
    edges, names, rels, qs = _search_parts(spark, d)
    own = traverse.limits(qs, seeds(spark, d))
    return traverse.search(seeds(spark, d), edges, names, rels, qs, BOUNDS, own).select("qid", "state", "node", F.round("score", 6).alias("score"), F.col("hop").cast("bigint").alias("hop"), "rank")


def _adaptive(spark, d):
    edges, names, rels, qs = _search_parts(spark, d)
    return traverse.search(seeds(spark, d), edges, names, rels, qs, BOUNDS, traverse.limits(qs, seeds(spark, d))), names, rels


@query()
def adaptive_context(spark, d):
    """The citation-labelled lines of every edge of each question's best paths, over all its hops."""
    return traverse.context(*_adaptive(spark, d))


@query()
def adaptive_answer(spark, d):
    """Sentences from the best path of each question, over all its hops; questions without a path get none."""
    return traverse.answer(*_adaptive(spark, d))


@query()
def adaptive_fair_share(spark, d):
    """Paths shared fairly among the seeds of each question, over all its hops and all states that survived."""
    edges, names, rels, qs = _search_parts(spark, d)
    own = traverse.limits(qs, seeds(spark, d), per_seed=4)
    every = own.withColumn("n_paths", F.col("hops") * F.col("width"))
    found = traverse.search(seeds(spark, d), edges, names, rels, qs, BOUNDS, every).join(own.select("qid", "n_paths"), "qid")
    paths = found.select("qid", F.split_part(F.split_part("state", F.lit(";"), F.lit(1)), F.lit(":"), F.lit(2)).alias("seed"), "state", "score", "n_paths")
    return traverse.fair_share(paths, F.col("n_paths")).select("qid", "seed", "state", F.round("score", 6).alias("score"), "rank")
