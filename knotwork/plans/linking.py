"""Queries of linking, scope, answers and the comparison of rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import graph as G
from knotwork.operators import answers, audit, kg, linking, retrieval, traverse, vectors
from knotwork.plans import graph, traverse as T_plans
from knotwork.plans.graph import ENC
from knotwork.plans.retrieval import DEN, GOLD, LINK, NRM, TOP, _ranked, _top, dense_scores, fused_pairs, gold_partitions, lexical_scores, question_vectors, centroid_vectors
from knotwork.plans.sqlparts import EDGES, ENT, MEM
from knotwork.plans.text import _LIT, _in
from knotwork.plans.traverse import SEEDS, questions, seeds
from knotwork.sources import table

QUERIES, SQL = {}, {}
SEED, DIMS = 17, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _random(rel: str, key: str) -> str:
    values = ", ".join(f"CAST('0x' || substr(md5('{SEED}:' || {key}), {1 + 4 * i}, 4) AS BIGINT) / 32768.0::DOUBLE - 1" for i in range(DIMS))
    return f"SELECT {key} AS k, [{values}] AS v FROM {rel}"


RND = f"rq AS ({_random('(SELECT item_id FROM test_items WHERE question IS NOT NULL)', 'item_id')}), rp AS ({_random('(SELECT partition_id FROM centroids)', 'partition_id')}), rnd AS (SELECT rq.k AS qid, rp.k AS id, round(list_dot_product(rq.v, rp.v), 9) AS score FROM rq, rp)"


def _random_vector(key):
    digest = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col(key).cast("string")))
    return F.array(*[F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("bigint") / 32768.0 - 1 for i in range(DIMS)])


def random_scores(spark, d, keep):
    """Scores without any meaning, the same in every engine: products of vectors made of the digits of hashed keys."""
    q = questions(spark, d).select("qid", _random_vector("qid").alias("vec"))
    p = table(spark, d, "centroids").select(F.col("partition_id").alias("id"), _random_vector("partition_id").alias("vec"))
    return vectors.products(q, p, keep=keep)


@query(f"WITH {RND} {_top('rnd')}")
def random_topk(spark, d):
    return _ranked(random_scores(spark, d, TOP).drop("rank"))


_RAW = f"{NRM}, rw AS (SELECT b.qid, b.id, round(0.5::DOUBLE * b.d + 0.5::DOUBLE * n.bn, 9) AS score FROM bo b JOIN nr n ON n.qid = b.qid AND n.id = b.id)"


@query(f"WITH {_RAW} {_top('rw')}")
def raw_dense_topk(spark, d):
    """Fusion with the dense scores as they are."""
    return _ranked(retrieval.fuse(fused_pairs(spark, d), normalize_dense=False))


_METHODS = f"""fu AS (SELECT qid, id, round(0.5::DOUBLE * dn + 0.5::DOUBLE * bn, 9) AS score FROM nr), rk AS (SELECT qid, id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY d DESC, id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY b DESC, id)), 9) AS score FROM bo),
al AS ({' UNION ALL '.join(f"SELECT '{name}' AS method, qid, id, rank FROM ({_top(rel, 5)})" for name, rel in (('random', 'rnd'), ('dense', 'den'), ('lexical', 'bm'), ('hybrid', 'fu'), ('rrf', 'rk')))}),
me AS (SELECT m.method, g.qid, min(a.rank) AS first, count(*) AS n_gold, count(a.rank) AS found FROM gold g CROSS JOIN (SELECT unnest(['random', 'dense', 'lexical', 'hybrid', 'rrf']) AS method) m LEFT JOIN al a ON a.method = m.method AND a.qid = g.qid AND a.id = g.id GROUP BY ALL)"""


@query(f"WITH {NRM}, {RND}, {GOLD}, {_METHODS} SELECT method, count(*) AS n, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(first, 99) <= 3)::INT), 6) AS hit_3, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS hit_5, round(avg(found::DOUBLE / n_gold), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr_5 FROM me GROUP BY method")
def retrieval_comparison(spark, d):
    """Five rankings of the same questions: hits, recall and reciprocal rank of the answers' partitions among the five best."""
    pairs = fused_pairs(spark, d)
    ranked = {
        "random": random_scores(spark, d, 5), "dense": dense_scores(spark, d, keep=5), "lexical": vectors.best(lexical_scores(spark, d), 5),
        "hybrid": vectors.best(retrieval.fuse(pairs), 5), "rrf": vectors.best(retrieval.reciprocal_rank_fusion(pairs), 5),
    }
    every = None
    for name, df in ranked.items():
        part = df.select(F.lit(name).alias("method"), F.col("qid").cast("bigint").alias("qid"), F.col("id").cast("bigint").alias("id"), "rank")
        every = part if every is None else every.unionByName(part)
    gold = gold_partitions(spark, d).withColumn("method", F.explode(F.array(*map(F.lit, ranked))))
    per = gold.join(every, ["method", "qid", "id"], "left").groupBy("method", "qid").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("found"))
    hit = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6).alias(f"hit_{k}")
    return per.groupBy("method").agg(F.count(F.lit(1)).alias("n"), hit(1), hit(3), hit(5), F.round(F.avg(F.col("found") / F.col("n_gold")), 6).alias("recall_5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr_5"))


# Linking.
def _in_order() -> str:
    grams = []
    for part, rel, longest in ((0, "q", 5), (1, "s", 4)):
        grams += [f"SELECT item_id, {part} AS part, {longest - n} AS len, i, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS m FROM (SELECT item_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM {rel})" for n in range(1, longest + 1)]
    return f"og AS ({' UNION ALL '.join(grams)}), om AS (SELECT item_id, m, CAST(row_number() OVER (PARTITION BY item_id ORDER BY min({{'p': part, 'l': len, 'i': i}})) - 1 AS INT) AS nth FROM og WHERE length(m) >= 2 AND m NOT IN {_in(T.MENTION_STOP)} GROUP BY item_id, m)"


ORD = f"{LINK}, {_in_order()}, mt AS (SELECT o.item_id, l.id, o.nth, least(0.3::DOUBLE, 0.1::DOUBLE * len(string_split(o.m, ' '))) AS s FROM om o JOIN lex l ON l.term = o.m), tp AS (SELECT item_id, id, max(s) AS score FROM mt GROUP BY ALL)"


def _asked(spark, d):
    return questions(spark, d).select("qid", F.posexplode(T.mentions(F.col("question"))).alias("nth", "term"))


def _names(spark, d):
    return kg.entities(spark, d).where("name <> ''").select("id", F.lower("name").alias("term"))


@query(f"WITH {ORD} SELECT t.item_id AS qid, t.id, round(t.score, 6) AS score, min(nth) AS earliest, max(nth) AS latest FROM tp t JOIN mt ON mt.item_id = t.item_id AND mt.id = t.id AND mt.s = t.score GROUP BY ALL")
def mention_order(spark, d):
    """Where the best mention of each linked entity stands first and last among a question's mentions."""
    return linking.mention_order(_asked(spark, d), _names(spark, d)).select("qid", "id", F.round("score", 6).alias("score"), "earliest", "latest")


def _links(spark, d):
    lex = _asked(spark, d).join(_names(spark, d), "term").groupBy("qid", "id").agg(F.max(F.size(F.split("term", " "))).alias("n_words"))
    dense = vectors.products(question_vectors(spark, d), graph.entity_vectors(spark, d), keep=50).select("qid", "id", F.col("score").alias("sim"))
    return linking.hybrid_links(lex, dense)


_QV = DEN[: DEN.index(", cen AS")]
HYB = f"""{LINK}, {_QV}, {ENC}, nw AS (SELECT me.item_id AS qid, l.id, max(len(string_split(me.m, ' '))) AS n FROM men me JOIN lex l ON l.term = me.m GROUP BY ALL), ln AS (SELECT qid, id, n::DOUBLE / greatest(max(n) OVER (PARTITION BY qid), 1) AS l FROM nw),
ds AS (SELECT q.qid, e.id, round(sum(q.val * e.val), 9) AS sim FROM qv q JOIN ev e ON e.dim = q.dim GROUP BY ALL), dk AS (SELECT qid, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM ds) WHERE r <= 50),
dn AS (SELECT qid, id, CASE WHEN count(*) OVER w > 1 THEN (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-9) ELSE sim END AS d FROM dk WINDOW w AS (PARTITION BY qid)),
hb AS (SELECT coalesce(ln.qid, dn.qid) AS qid, coalesce(ln.id, dn.id) AS id, round(0.7::DOUBLE * coalesce(l, 0) + 0.3::DOUBLE * coalesce(d, 0), 9) AS score FROM ln FULL JOIN dn ON dn.qid = ln.qid AND dn.id = ln.id),
hl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hb) WHERE rank <= 5)"""


@query(f"WITH {HYB} SELECT qid, id, round(score, 6) AS score, rank FROM hl")
def hybrid_linker(spark, d):
    return _links(spark, d).select("qid", "id", F.round("score", 6).alias("score"), "rank")


_TOPICS = f"gd AS (SELECT DISTINCT item_id AS qid, unnest({_LIT.format(c='q_entity')}) AS id FROM test_items)"


@query(f"WITH {HYB}, {_TOPICS}, np AS (SELECT qid, count(*) AS n FROM hl WHERE rank <= 3 GROUP BY qid), per AS (SELECT g.qid, count(*) AS n_gold, count(*) FILTER (h.rank <= 3) AS found, min(h.rank) AS first FROM gd g LEFT JOIN hl h ON h.qid = g.qid AND h.id = g.id GROUP BY g.qid) SELECT per.qid, n_gold, round(found::DOUBLE / n_gold, 6) AS recall, round(coalesce(found::DOUBLE / np.n, 0), 6) AS precision, coalesce((first = 1)::INT, 0) AS hit_1, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM per LEFT JOIN np ON np.qid = per.qid")
def linker_metrics(spark, d):
    return linking.link_metrics(_links(spark, d), seeds(spark, d))


@query()
def robust_mentions(spark, d):
    return questions(spark, d).select("qid", F.posexplode(linking.robust_mentions(F.col("question"))).alias("nth", "mention"))


@query()
def robust_seeds(spark, d):
    """Seeds of every test question by the robust rules, in the scope of its five best partitions."""
    scope = vectors.best(retrieval.fuse(fused_pairs(spark, d)), 5).select("qid", F.col("id").cast("int").alias("pid"))
    scored = linking.robust_scores(questions(spark, d), kg.entities(spark, d), kg.members(spark, d), scope, audit.degrees(kg.edges(spark, d)))
    return linking.robust_selection(scored).select("qid", "id", "term", F.round("confidence", 6).alias("confidence"), "rank")


# Scope.
_MATCH = T_plans.SQL["relation_relevance"]
_BRIDGE = T_plans.SQL["bridge_partitions"]
_COMPLETE = f"""hit AS (SELECT qid, id AS pid, score FROM (WITH {DEN} {_top('den', 5)})), br AS ({_BRIDGE}), rr AS ({_MATCH}),
sp AS (SELECT DISTINCT s.qid, m.pid FROM (SELECT item_id AS qid, unnest({_LIT.format(c='q_entity')}) AS id FROM test_items) s JOIN (WITH {MEM} SELECT * FROM mem) m ON m.id = s.id),
ad AS (SELECT qid, pid FROM sp UNION SELECT br.qid, br.pid FROM br JOIN rr ON rr.qid = br.qid AND rr.relation = br.rel_name WHERE rr.relevance = 1)"""


@query(f"WITH {_COMPLETE} SELECT qid, pid, score FROM hit UNION ALL SELECT qid, pid, 0.0::DOUBLE FROM ad WHERE (qid, pid) NOT IN (SELECT (qid, pid) FROM hit)")
def scope_completion(spark, d):
    """The five best partitions of each question, and with score 0 those of its seeds and of bridges whose relation matches the question."""
    hits = dense_scores(spark, d, keep=5).select("qid", F.col("id").cast("int").alias("pid"), F.round("score", 6).alias("score"))
    own = seeds(spark, d).join(kg.members(spark, d), "id").select("qid", "pid")
    bridges = T_plans.bridge_partitions(spark, d).join(questions(spark, d), "qid").where(traverse.relation_relevance(F.col("rel_name"), F.col("question")) == 1.0).select("qid", "pid")
    more = own.unionByName(bridges).distinct().join(hits, ["qid", "pid"], "left_anti")
    return hits.unionByName(more.select("qid", "pid", F.lit(0.0).alias("score")))


FIRST, WIDER = 5, 20


@query(f"WITH {EDGES}, {SEEDS}, {MEM}, {DEN}, t AS ({_top('den', WIDER)}), c AS (SELECT DISTINCT s.qid, e.src, e.rel, e.dst, t.rank FROM sd s JOIN edg e ON e.src = s.id JOIN mem m ON m.id = e.dst JOIN t ON t.qid = s.qid AND t.id = m.pid), n AS (SELECT q.item_id AS qid, count(*) FILTER (rank <= {FIRST}) AS a, count(rank) AS b FROM test_items q LEFT JOIN c ON c.qid = q.item_id WHERE q.question IS NOT NULL GROUP BY 1) SELECT qid, CASE WHEN a > 0 THEN {FIRST} ELSE {WIDER} END AS top_k, CASE WHEN a > 0 THEN a ELSE b END AS n_edges FROM n")
def scope_retry(spark, d):
    """How many partitions a question is searched in: where the five best give no edge, the twenty best."""
    scope = dense_scores(spark, d, keep=WIDER).select("qid", F.col("id").cast("int").alias("pid"), "rank")
    met = seeds(spark, d).distinct().join(kg.edges(spark, d), F.col("id") == F.col("src")).join(kg.members(spark, d).withColumnRenamed("id", "dst"), "dst").join(scope, ["qid", "pid"])
    n = questions(spark, d).select("qid").join(met.select("qid", "src", "rel", "dst", "rank").distinct(), "qid", "left").groupBy("qid").agg(F.count_if(F.col("rank") <= FIRST).alias("a"), F.count("rank").alias("b"))
    return n.select("qid", F.when(F.col("a") > 0, FIRST).otherwise(WIDER).alias("top_k"), F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("n_edges"))


# Contexts and answers.
@query()
def grounded_context(spark, d):
    paths, names, rels = T_plans._adaptive(spark, d)
    return answers.context(answers.labelled_edges(paths, names, rels), answers.seed_lines(seeds(spark, d), names))


@query()
def grounded_answers(spark, d):
    """An answer with matched citations for every test question; questions without a path say so."""
    paths, names, rels = T_plans._adaptive(spark, d)
    out = answers.answers(questions(spark, d), paths, seeds(spark, d), names, rels)
    return out.select("qid", "answer", F.array_join("citations", ",").alias("citations"), "was_skipped")


# Small operators.
@query(f"WITH {ENT} SELECT id, name, descr FROM ent WHERE id = (SELECT min(id) FROM ent)")
def point_lookup(spark, d):
    ents = kg.entities(spark, d)
    return kg.lookup(ents, ents.agg(F.min("id")).scalar()).select("id", "name", "descr")


@query("SELECT item_id FROM test_items WHERE question IS NOT NULL AND item_id IN (SELECT item_id FROM test_items WHERE passage IS NOT NULL) ORDER BY item_id")
def id_intersection(spark, d):
    t = table(spark, d, "test_items")
    return t.where("question is not null").select("item_id").join(t.where("passage is not null").select("item_id"), "item_id").distinct().orderBy("item_id")


@query("SELECT item_id, question FROM test_items ORDER BY item_id LIMIT 25")
def head_of_items(spark, d):
    return table(spark, d, "test_items").select("item_id", "question").orderBy("item_id").limit(25)


@query(f"WITH {MEM} SELECT pid, count(*) AS n_members, array_to_string(list_slice(list(id ORDER BY id), 1, 5), ',') AS first_members FROM mem GROUP BY pid")
def community_lists(spark, d):
    """Size and first five members of every partition; later members fall away on the map side."""
    mem = kg.members(spark, d)
    first = mem.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("id"))).where("nth <= 5").groupBy("pid").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_members"))
    return graph.partition_sizes(spark, d).join(first, "pid").select("pid", F.col("size").alias("n_members"), "first_members")


@query(r"SELECT item_id, unnest(list_distinct([q, regexp_replace(q, '''s\b', '', 'g')])) AS variant FROM (SELECT item_id, lower(replace(question, '’', '''')) AS q FROM test_items WHERE question IS NOT NULL)")
def possessive_variants(spark, d):
    q = F.lower(F.replace("question", F.lit("’"), F.lit("'")))
    return table(spark, d, "test_items").where("question is not null").select("item_id", F.explode(linking.possessive_variants(q)).alias("variant"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS half_even FROM lineitem")
def half_even_rounding(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 8, 2).alias("half_even"))


@query(f"WITH {graph.SIM}, so AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(sim, 9) AS sim FROM si WHERE src <> dst), lo AS (SELECT min(sim) AS m FROM so) SELECT u, v, round(sum(pow(coalesce(sim, m) + abs(m) + 1e-4, 2)), 6) AS w FROM so, lo GROUP BY ALL")
def controlled_graph(spark, d):
    """Weights always shifted by the lowest similarity, whatever its sign."""
    g = G.weighted_graph(graph.structural_edges(spark, d).select("src", "dst"), graph.entity_vectors(spark, d), always=True)
    return g.select("u", "v", F.round("w", 6).alias("w"))
