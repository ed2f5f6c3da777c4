"""Queries of the text functions, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import kg
from knotwork.plans.sqlparts import ALIASES, ENT, MEM, norm
from knotwork.sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
ASC = "regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _tok(c):
    return TOK.format(c=c)


def _asc(c):
    return ASC.format(c=c)


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tok('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokens_unicode(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_asc('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokens_ascii(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.ascii_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT item_id, array_to_string(list_filter({_asc('question')}, lambda t: t NOT IN {_in(T.STOP_WORDS)}), ' ') AS content FROM test_items WHERE question IS NOT NULL")
def traversal_tokens(spark, d):
    return table(spark, d, "test_items").where("question is not null").select("item_id", F.array_join(T.content_tokens(F.col("question")), " ").alias("content"))


@query(f"SELECT item_id, array_to_string(list_filter({_tok('passage')}, lambda t: t NOT IN {_in(T.ARTICLES)}), ' ') AS key FROM test_items WHERE passage IS NOT NULL")
def answer_norm_v1(spark, d):
    return table(spark, d, "test_items").where("passage is not null").select("item_id", T.answer_key(F.col("passage")).alias("key"))


@query(rf"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace(lower(passage), '<pad>', ' '), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda t: t <> '' AND t NOT IN {_in(T.ARTICLES)}), ' ') AS key FROM test_items WHERE passage IS NOT NULL")
def answer_norm_v2(spark, d):
    return table(spark, d, "test_items").where("passage is not null").select("item_id", T.answer_text(F.col("passage")).alias("key"))


@query(f"WITH {ENT} SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, {norm('name')} AS folded FROM ent")
def name_keys(spark, d):
    return kg.entities(spark, d).select("id", T.compact_key(F.col("name")).alias("key"), kg.normal(F.col("name")).alias("folded"))


@query(f"WITH {ENT}, w AS (SELECT id, list_filter({_asc('name')}, lambda t: length(t) >= 2 AND t NOT IN {_in(T.MENTION_STOP)}) AS w FROM ent) SELECT id, CASE WHEN len(w) <= 4 THEN array_to_string(w, ' ') ELSE '' END AS key FROM w")
def mention_keys(spark, d):
    return kg.entities(spark, d).select("id", T.mention_key(F.col("name")).alias("key"))


def _parts(pattern, extra=""):
    return rf"list_filter(list_transform(regexp_split_to_array(passage, '{pattern}'), lambda x: trim(x)), lambda x: x <> ''{extra})"


@query(rf"SELECT DISTINCT item_id, unnest({_parts('[,' + chr(92) + 'n' + chr(92) + 'r]+')}) AS part FROM test_items WHERE passage IS NOT NULL")
def candidate_split(spark, d):
    return table(spark, d, "test_items").where("passage is not null").select("item_id", F.explode(T.split_distinct(F.col("passage"), "[,\n\r]+")).alias("part"))


@query(rf"SELECT DISTINCT item_id, phrase FROM (SELECT item_id, unnest({_parts('[,;:' + chr(92) + 'n]+')}) AS phrase FROM test_items WHERE passage IS NOT NULL) WHERE len(string_split(phrase, ' ')) <= 5")
def phrase_split(spark, d):
    parts = table(spark, d, "test_items").where("passage is not null").select("item_id", F.explode(T.split_distinct(F.col("passage"), "[,;:\n]+")).alias("phrase"))
    return parts.where(F.size(F.split("phrase", " ")) <= 5)


@query(r"SELECT item_id, unnest(regexp_extract_all(grounding, '\bQ[0-9]+\b')) AS id FROM test_items")
def qid_extraction(spark, d):
    return table(spark, d, "test_items").select("item_id", F.explode(T.entity_ids(F.col("grounding"))).alias("id"))


@query(r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\[(P[0-9]+\.E[0-9]+|S[0-9]+)\]', 1))) AS label FROM documents")
def citation_extraction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.citation_labels(F.col("text"))).alias("label"))


_GRAMS = " UNION ALL ".join(f"SELECT item_id, {n} AS n, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS gram FROM (SELECT item_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM q)" for n in range(1, 6))


@query(f"WITH q AS (SELECT item_id, {_asc('question')} AS t FROM test_items WHERE question IS NOT NULL) SELECT item_id, gram, count(*) AS times FROM ({_GRAMS}) GROUP BY ALL")
def question_ngrams(spark, d):
    grams = table(spark, d, "test_items").where("question is not null").select("item_id", F.explode(T.ngrams(T.ascii_tokens(F.col("question")), 5)).alias("gram"))
    return grams.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("times"))


def _grams_of(rel: str, longest: int) -> str:
    return " UNION ALL ".join(f"SELECT item_id, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS m FROM (SELECT item_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM {rel})" for n in range(1, longest + 1))


def _mentions(part: str) -> str:
    return rf"""q AS (SELECT item_id, regexp_extract_all(lower(replace(question, '’', '''')), '{part}(?:''{part})?') AS t FROM test_items WHERE question IS NOT NULL),
s AS (SELECT item_id, list_filter(t, lambda x: length(x) >= 2 AND x NOT IN {_in(T.STOP_WORDS)}) AS t FROM q),
men AS (SELECT DISTINCT item_id, m FROM ({_grams_of('q', 5)} UNION ALL {_grams_of('s', 4)}) WHERE length(m) >= 2 AND m NOT IN {_in(T.MENTION_STOP)})"""


MENTIONS = _mentions(r"[\p{L}\p{N}]+")


@query(f"WITH {_mentions('[a-z0-9]+')} SELECT item_id, m AS mention FROM men")
def mentions_ascii(spark, d):
    return table(spark, d, "test_items").where("question is not null").select("item_id", F.explode(T.mentions(F.col("question"), ascii_only=True)).alias("mention"))


@query(f"WITH {MENTIONS} SELECT item_id, m AS mention FROM men")
def mentions_base(spark, d):
    return table(spark, d, "test_items").where("question is not null").select("item_id", F.explode(T.mentions(F.col("question"))).alias("mention"))


@query(rf"WITH {ENT} SELECT id, rtrim(substr(trim(regexp_replace(descr, '\s+', ' ', 'g')), 1, 240)) AS short FROM ent")
def description_short(spark, d):
    return kg.entities(spark, d).select("id", T.shorten(F.col("descr"), 240).alias("short"))


_LIT = r"list_filter(list_transform(string_split(regexp_replace(trim({c}), '^\[|\]$', '', 'g'), ','), lambda x: regexp_replace(trim(x), '^[''\"]|[''\"]$', '', 'g')), lambda x: x <> '')"


@query("SELECT item_id, 'answer' AS field, unnest(" + _LIT.format(c="answer") + ") AS id FROM test_items UNION ALL SELECT item_id, 'q_entity', unnest(" + _LIT.format(c="q_entity") + ") FROM test_items")
def literal_lists(spark, d):
    t = table(spark, d, "test_items")
    return t.select("item_id", F.lit("answer").alias("field"), F.explode(T.literal_list(F.col("answer"))).alias("id")).unionByName(t.select("item_id", F.lit("q_entity").alias("field"), F.explode(T.literal_list(F.col("q_entity"))).alias("id")))


PREMISES = r"SELECT item_id, rule_index, generate_subscripts(p, 1) AS pos, unnest(p) AS premise FROM (SELECT item_id, rule_index, list_transform(list_filter(list_transform(string_split(string_split(grounding, '=>')[1], '|'), lambda t: list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '')), lambda p: len(p) >= 3), lambda p: array_to_string(p[1:3], '|')) AS p FROM test_items)"


@query(f"SELECT item_id, pos, premise FROM ({PREMISES})")
def grounding_premises(spark, d):
    return table(spark, d, "test_items").select("item_id", F.posexplode(T.premises(F.col("grounding"))).alias("pos", "premise")).select("item_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "premise")


@query(r"SELECT item_id, coalesce(list_filter(regexp_split_to_array(trim(string_split(grounding, '=>')[2]), '\s+'), lambda x: x <> '')[-1], " + _LIT.format(c="answer") + "[1]) AS hard_answer FROM test_items")
def hard_answers(spark, d):
    return table(spark, d, "test_items").select("item_id", F.coalesce(T.conclusion(F.col("grounding")), F.get(T.literal_list(F.col("answer")), F.lit(0))).alias("hard_answer"))


EMBED = f"name || CASE WHEN len({ALIASES}) > 0 THEN ' Also known as: ' || array_to_string(list_slice({ALIASES}, 1, 8), ', ') ELSE '' END || CASE WHEN descr <> '' THEN '. ' || substr(descr, 1, 300) ELSE '' END"


@query(f"WITH {ENT} SELECT id, {EMBED} AS txt FROM ent")
def embedding_text(spark, d):
    return kg.entities(spark, d).select("id", T.embedding_text(F.col("name"), kg.alias_list("aliases"), F.col("descr")).alias("txt"))


@query(f"""WITH {ENT}, {MEM}, p AS (SELECT m.pid, e.id, trim(e.name || ' ' || replace(e.aliases, '|', ' ') || ' ' || substr(e.descr, 1, 200)) AS piece FROM mem m JOIN ent e ON e.id = m.id),
r AS (SELECT *, sum(length(piece)) OVER (PARTITION BY pid ORDER BY id) AS upto FROM p WHERE piece <> '')
SELECT pid, count(*) AS n_members, CAST(sum(length(piece)) AS BIGINT) AS n_chars, md5(string_agg(piece, ' ' ORDER BY id)) AS digest FROM r WHERE upto - length(piece) <= 5000 GROUP BY pid""")
def partition_text(spark, d):
    """Texts of a partition's members in the order of ids, up to the first that passes 5,000 characters."""
    piece = F.trim(F.concat_ws(" ", "name", F.replace("aliases", F.lit("|"), F.lit(" ")), F.substring("descr", 1, 200)))
    p = kg.members(spark, d).join(kg.entities(spark, d), "id").select("pid", "id", piece.alias("piece"))
    # 5,001 pieces of at least one character reach the limit: later ranks fall away on the map side, before the running sum.
    order = Window.partitionBy("pid").orderBy("id")
    p = p.where("piece <> ''").withColumn("nth", F.row_number().over(order)).where("nth <= 5001")
    p = p.withColumn("upto", F.sum(F.length("piece")).over(order)).where(F.col("upto") - F.length("piece") <= 5000)
    return p.groupBy("pid").agg(F.count(F.lit(1)).alias("n_members"), F.sum(F.length("piece")).alias("n_chars"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "piece"))), lambda x: x["piece"]), " ")).alias("digest"))


@query(rf"SELECT item_id, CASE WHEN regexp_matches(lower(question), '{T.AGGREGATION}') THEN 'SET_AGGREGATION' ELSE 'SINGULAR_FACT' END AS intent, CASE WHEN regexp_matches(lower(question), '{T.AGGREGATION}') THEN 12 ELSE 3 END AS max_paths, CASE WHEN regexp_matches(lower(question), '{T.AGGREGATION}') THEN 15 ELSE 5 END AS beam_width FROM test_items WHERE question IS NOT NULL")
def intent_detect(spark, d):
    many = F.lower("question").rlike(T.AGGREGATION)
    return table(spark, d, "test_items").where("question is not null").select("item_id", F.when(many, "SET_AGGREGATION").otherwise("SINGULAR_FACT").alias("intent"), F.when(many, 12).otherwise(3).alias("max_paths"), F.when(many, 15).otherwise(5).alias("beam_width"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {ENT}, nm AS (SELECT t.item_id, t.question, e.id, e.name FROM (SELECT item_id, question, unnest({_LIT.format(c='q_entity')}) AS q FROM test_items) t JOIN ent e ON e.id = t.q) SELECT item_id, id, replace(question, name, id) AS raw, replace(replace(question, name, id), id, name) AS restored, NOT regexp_matches(question, 'Q[0-9]+') AS usable FROM nm WHERE name <> ''")
def qid_substitution(spark, d):
    q = table(spark, d, "test_items").select("item_id", "question", F.explode(T.literal_list(F.col("q_entity"))).alias("id"))
    named = q.join(kg.entities(spark, d).select("id", "name").where("name <> ''"), "id")
    raw = F.replace("question", F.col("name"), F.col("id"))
    return named.select("item_id", "id", raw.alias("raw"), F.replace(raw, F.col("id"), F.col("name")).alias("restored"), (~F.col("question").rlike("Q[0-9]+")).alias("usable"))
